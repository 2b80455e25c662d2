"""Prompt tables (P4, R9, F2, J10): templates rendered as Column expressions; a batch inference
job (or a pandas UDF) consumes the prompt table and its answers are joined back by prompt id."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: prompt texts that must equal the reference's --------------------------------
RELEVANCY_TEMPLATE = """As a grader, your task is to evaluate the relevance of a document retrieved in response to a user's question.

    Retrieved Document:
    -------------------
    {context_str}

    Metadata:
    ---------
    {metadata}

    User Question:
    --------------
    {query_str}

    Evaluation Criteria:
    - Consider whether the document contains keywords or topics related to the user's question.
    - The evaluation should not be overly stringent; the primary objective is to identify and filter out clearly irrelevant retrievals.

    Decision:
    - Assign a binary score to indicate the document's relevance.
    - Use 'yes' if the document is relevant to the question, or 'no' if it is not.

    Please provide your binary score ('yes' or 'no') below to indicate the document's relevance to the user question."""

TRANSFORM_QUERY_TEMPLATE = """    You are a question re-writer that converts an input question to a better version that is optimized
    for web search. Look at the input and try to reason about the underlying semantic intent / meaning.
    Original Query:
    -------
    {query_str}
    -------
    Formulate an improved question.    """
EVALUATE_QUERY_TEMPLATE = """    You are a query evaluator. Your task is to classify user inputs into one of the following types:

    1. **Question** – The input is seeking specific information or an answer. It usually ends with a question mark or starts with question words like "what", "how", "why", etc.

    2. **Conversational** – The input is more casual or interactive in nature. It may express thoughts, feelings, or initiate/continue a conversation without explicitly asking a question.

    3. **Chat** – The input is a chat message or a part of a conversation. It may be a response to a previous message or a standalone message.

    If the input is neither of the above (e.g., a statement or command), return: "neither".

    Respond with only one word: "question", "conversational", "chat", or "neither".

    Examples:
    - "What is the capital of Japan?" -> question
    - "Hey, what's up?" -> conversational
    - "The server is running." -> neither
    - "Tell me about the new update." -> conversational
    - "Who won the game yesterday?" -> question
    - "What was the previous question?" -> chat
    - "Based from the chat or conversation, what's the summary?" -> chat
    - "Can you tell me more about the topic?" -> question

    Now classify the following prompt:
    {query_str}
    """

PREDICT_ANSWER_TEMPLATE = """    Go through the following context and then get the  answer of the question from the context.
    Choose the most relevant text from the context and answer from it.

    Context:
    -------
    {context}
    -------

    Question:
    -------
    {question}
    -------    """

PREDICT_LONG_ANSWER_TEMPLATE = """    Go through the following context and then extract the answer of the question from the context.
    Answer the question directly. Your answer should be concise.

    The context is a list of Wikipedia documents, ordered by title: {titles}.
    Each Wikipedia document contains a 'title' field and a 'text' field.

    Choose the most relevant text from the context and extract the answer from it.

    The context is: {context}.
    The question: {question}.    """

EXPLAIN_TEMPLATE = """    With the question: {question}

    Can you explain the following context in a way that a 5-year-old can understand?

    -----
    {context}
    -----

    Break down complex concepts using simple words, analogies, and everyday examples.
    Avoid technical jargon.

    Go through the following context and then extract the answer of the question from the context.
    Answer the question directly. Your answer should be concise.
    """

CHAT_RELEVANCY_TEMPLATE = RELEVANCY_TEMPLATE.replace("    Metadata:\n    ---------\n    {metadata}\n\n", "")
# -----------------------------------------------------------------------------------------------

_FIELD = re.compile(r"\{(\w+)\}")


def render(template: str, **values: Column) -> Column:
    """``template.format(**values)`` for plain ``{name}`` fields, as one ``concat``."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)].cast("string"))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def chat_rewrite_input(query: Column, relevant_text: Column, history: Column) -> Column:
    """R9, chat variant: what goes into the rewrite prompt as the query: the query, the relevant text and
    the earlier messages (already rendered)."""
    return F.concat(query, F.lit("\n\n"), relevant_text, F.lit("\n\nPrevious chat history:\n"), history)


def py_dict_repr(**fields: Column) -> Column:
    """Python ``str()`` of a flat dict of strings, in the given key order."""
    items = []
    for i, (k, v) in enumerate(fields.items()):
        items += [F.lit(("" if i == 0 else ", ") + f"'{k}': '"), v.cast("string"), F.lit("'")]
    return F.concat(F.lit("{"), *items, F.lit("}"))


def join_responses(prompts: DataFrame, responses: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Answers produced outside Spark (or by a pandas UDF job) joined back by prompt id."""
    return prompts.join(responses, key, "left")
