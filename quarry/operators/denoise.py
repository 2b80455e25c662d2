"""Denoising training-set generation.

Rows are (row_id, target, passages array<string>, scores array<double>) with dense row ids.
Everything is row-local Column work except the vocabulary (one global token count) and the
per-task counts for the split (one tiny aggregate):

* Every draw is a slice of md5(seed:row:passage:position): reproducible, independent along a passage
  and identical in SQL; ``rand()`` is never used.
* T4 (mask a selected position and the next one, the second consuming its own selection) is a
  replacement over a per-passage code string: '1' eligible selected, '0' plain, '2' special.
  In a run of '1's the starts are the even offsets ('11' -> 'SC', lone '1' -> 'S'), and a start
  right before a plain token consumes it ('S0' -> 'SC'). Equal to the sequential scan.
* T8 positions inside a task follow from the row id in closed form (task = f(row div 4)), so no
  window is partitioned by the three task values (each holds a third of the rows).
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.tables import dense_position, written

# ---- fixed values (reference constants) --------------------------------------------------------
MASK_P = 0.3
MASK_FRAC, KEEP_FRAC = 0.5, 0.6            # < 0.5 mask, (0.5, 0.6) keep, else replace
VOCAB_LO, VOCAB_HI = 3, 31999              # replacement ids
IGNORE_INDEX = -100
BOS, EOS, MASK, REF = "<s>", "</s>", "[MASK]", "[REFERENCE]"
SPECIALS = (BOS, MASK, REF)
QUERY_TEMPLATE = "Complete this text according to the above [REFERENCE]: "
TRACE_CAC = "This content is generated according to my knowledge and [REFERENCE] number "
TRACE_CS = "This content is generated according to my knowledge"
TRACE_SC = "This content is generated according to [REFERENCE] number "
TASKS = ("cac", "cs", "sc")                 # batch mod 10: 0-3, 4-7, 8-9
DATA_ORDER = ("cac", "sc", "cs")            # order of tasks in the combined outputs
COMMON = 1 << 18                            # tokens whose ids are sent to all tasks (not a reference constant)
# -----------------------------------------------------------------------------------------------


def draw(*parts, seed: int) -> Column:
    """32 uniform bits for a key, the same in any engine that has md5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def assign_task(row: Column) -> Column:
    """batch = row div 4; batch mod 10 in 0-3 -> cac, 4-7 -> cs, 8-9 -> sc."""
    b = F.pmod(F.floor(row / 4), F.lit(10))
    return F.when(b < 4, "cac").when(b < 8, "cs").otherwise("sc")


def task_position(row: Column) -> Column:
    """0-based position of a row among the rows of its task (rows are dense 0..n-1)."""
    bt = F.floor(row / 4)
    c, m, r = F.floor(bt / 10), F.pmod(bt, F.lit(10)), F.pmod(row, F.lit(4))
    return (F.when(m < 4, c * 16 + m * 4 + r).when(m < 8, c * 16 + (m - 4) * 4 + r)
            .otherwise(c * 8 + (m - 8) * 4 + r)).cast("long")


def reference_passages(passages: Column) -> Column:
    """Prefix every passage with '[REFERENCE] '."""
    return F.transform(passages, lambda p: F.concat(F.lit(REF + " "), p))


def drop_target(passages: Column, target: Column) -> Column:
    """The contextual task omits passages equal to the target."""
    return F.filter(passages, lambda p: p != target)


def source_index(scores: Column) -> Column:
    """Index of the first score equal to 0, else 0."""
    return F.greatest(F.array_position(scores, F.lit(0.0)), F.lit(1)) - 1


def passage_tokens(passage: Column) -> Column:
    """Start marker, reference marker, then the passage's M9 tokens."""
    return F.concat(F.array(F.lit(BOS), F.lit(REF)), T.tokenize(passage))


def mark(codes: str) -> str:
    """T4: 'S' start, 'C' consumed follower, others unchanged."""
    return codes.replace("11", "SC").replace("1", "S").replace("S0", "SC")


def _passage(row: int, pidx: int, toks: list[str], vocab: list[str], seed: int):
    """T3-T5 of one passage: codes, marks, corrupted tokens. One md5 a token gives its three draws."""
    low, key = len(toks) // 3, f"{seed}:{row}:{pidx}:".encode()
    draws = np.frombuffer(b"".join([md5(key + b"%d" % i).digest() for i in range(low, len(toks))]), ">u4").reshape(-1, 4)
    codes = bytearray(b"0" * low + np.where(draws[:, 0] < MASK_P * 2**32, b"1", b"0").tobytes())
    for i, t in enumerate(toks):
        if t in SPECIALS:
            codes[i] = 50                                                       # '2'
    codes = codes.decode()
    marks = mark(codes)
    out = list(toks)
    kind = draws[:, 1] / 2**32
    for i in np.flatnonzero(np.isin(np.frombuffer(marks.encode(), np.uint8)[low:], (67, 83))).tolist():         # 'C', 'S'
        if kind[i] < MASK_FRAC:
            out[low + i] = MASK
        elif kind[i] >= KEEP_FRAC:
            at = int(draws[i, 2]) % (VOCAB_HI - VOCAB_LO + 1)
            out[low + i] = vocab[at] if at < len(vocab) else "<unk>"
    return codes, marks, out


def mask_passages(df: DataFrame, vocab: list[str], seed: int) -> DataFrame:
    """T3-T5 for rows (row_id, pidx, toks): adds codes, marks, corrupted.

    T3 codes: '2' special, '1' selected (position >= n div 3 and a draw below 0.3), else '0'. T4 marks as
    in :func:`mark`. T5: masked positions become '[MASK]' (50%), stay (10%) or become a vocabulary token
    (40%). Row-local: Arrow batches pass once, the vocabulary (at most 31,997 tokens) is broadcast, nothing
    is joined or shuffled.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        for b in batches:
            rows, pidx, toks = (b.column(c).to_pylist() for c in ("row_id", "pidx", "toks"))
            got = [_passage(r, p, t, sent.value, seed) for r, p, t in zip(rows, pidx, toks)]
            codes, marks, out = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("row_id"), b.column("pidx"), b.column("toks"), pa.array(codes, pa.string()), pa.array(marks, pa.string()),
                 pa.array(out, pa.list_(pa.string()))], ["row_id", "pidx", "toks", "codes", "marks", "corrupted"])
    return (df.select(F.col("row_id").cast("long").alias("row_id"), F.col("pidx").cast("int").alias("pidx"), "toks")
            .mapInArrow(run, "row_id long, pidx int, toks array<string>, codes string, marks string, corrupted array<string>"))


def token_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, count) of all M9 tokens: one partially aggregated count per token."""
    return docs.select(F.explode(T.tokenize(F.col(text))).alias("token")).groupBy("token").count()


def replacement_vocabulary(frequencies: DataFrame) -> list[str]:
    """The replacement tokens of T5, ids 3..31999: the 31,997 most frequent (count desc, token asc)."""
    top = frequencies.orderBy(F.col("count").desc(), F.col("token").asc()).limit(VOCAB_HI - VOCAB_LO + 1)
    return [r.token for r in sorted(top.collect(), key=lambda r: (-r["count"], r.token))]


def token_ids(frequencies: DataFrame) -> DataFrame:
    """(token, id) of every token, ids from 3 on by (count desc, token asc). No token is left out."""
    return dense_position(frequencies, F.col("count").desc(), F.col("token").asc(), name="id").select(
        "token", (F.col("id") + VOCAB_LO).alias("id"))


def encode(texts: DataFrame, ids: DataFrame, key: str, text: str = "text", common: int = COMMON) -> DataFrame:
    """(key, position, id) of every token of every text; an unknown token has id 0.

    Ids rise as tokens get rarer, so those of the ``common`` most frequent tokens are broadcast and most tokens never leave
    their task; only the other tokens are shuffled to meet the other ids. Texts are tokenised once: what the broadcast
    gives is written to the shared folder.
    """
    toks = texts.select(key, F.posexplode(T.tokenize(F.col(text))).alias("position", "token"))
    first = F.broadcast(ids.where(F.col("id") < VOCAB_LO + common))            # a bounded part of the vocabulary
    met = written(toks.join(first, "token", "left").select(key, "position", "id", F.when(F.col("id").isNull(), F.col("token")).alias("token")), "token-ids")
    far = met.where("id is null").drop("id").join(ids.where(F.col("id") >= VOCAB_LO + common), "token", "left")
    return met.where("id is not null").select(key, "position", "id").union(far.select(key, "position", F.coalesce("id", F.lit(0)).alias("id")))


def labels(n_input: Column, n_ignored: Column, ids: Column) -> Column:
    """The label array: IGNORE_INDEX for the first ``n_ignored`` positions, then the ids."""
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), n_ignored.cast("int")), F.slice(ids, n_ignored.cast("int") + 1, n_input.cast("int")))


def split(task_pos: Column, n_task: Column, mode: str = "complementary") -> Column:
    """train = first int((n+1)*0.8) rows of the task. ``mode='reference'`` takes test from
    int(n*0.8+1) (may drop a row, Q8); the default makes test the complement."""
    cut = F.floor((n_task + 1) * 0.8)
    if mode == "reference":
        return (F.when(task_pos < cut, "train")
                .when(task_pos >= F.floor(n_task * 0.8 + 1), "test").otherwise("dropped"))
    return F.when(task_pos < cut, "train").otherwise("test")


def eval_slice(row: Column, n: Column, data_type: str) -> Column:
    """T11: 'train' keeps all rows; otherwise rows from int(0.2 * n) + 1 on (1 = kept)."""
    if data_type == "train":
        return F.lit(1)
    return (row >= F.floor(n * 0.2) + 1).cast("int")
