from pyspark.sql import functions as F

from quarry.functions import prompts as PR


def test_templates_render(spark):
    names = [n for n in dir(PR) if n.endswith("_TEMPLATE")]
    assert len(names) == 7
    for n in names:
        fields = set(PR._FIELD.findall(getattr(PR, n)))
        text = spark.range(1).select(PR.render(getattr(PR, n), **{f: F.lit(f"<{f}>") for f in fields})).first()[0]
        assert all(f"<{f}>" in text for f in fields) and "{" not in text
    assert "Metadata" not in PR.CHAT_RELEVANCY_TEMPLATE and "{context_str}" in PR.CHAT_RELEVANCY_TEMPLATE
    one = spark.range(1).select(PR.chat_rewrite_input(F.lit("q"), F.lit("r"), F.lit("h"))).first()[0]
    assert one == "q\n\nr\n\nPrevious chat history:\nh"
