"""Operator 2: token counts from pieces counted once per distinct pre-token."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymill.llm.support import portions, texts
from delaymill.session import spool

PRETOKEN = re.compile(r" *[^ ]+| +")
HELD = 200_000  # distinct pre-tokens a task adds up before it hands them on
HOT_TOKENS = 200_000  # pre-tokens whose piece counts every task holds
HOT_LENGTH = 48  # code points of the longest of them: 200 000 x 48 bounds the broadcast


def pretokens(text: str) -> list[str]:
    """Parts of a text that merges of the tokenizer never cross: a run of spaces and what follows up to the next.

    The tokenizer puts a space in front and treats the mark U+2581 as a space, hence both replacements.
    """
    return PRETOKEN.findall((" " + text).replace("▁", " ")) if text else []


def load_model(path: str):
    """The tokenizer, after a check that none of its pieces has a space behind another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if "▁" in p.lstrip("▁")]
    if crossing:
        raise ValueError(f"pieces cross pre-tokens: {crossing[:3]}")
    return model


def piece_counts(model, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token; the model adds the leading space itself, but not to an empty text."""
    counts = [len(ids) for ids in model.encode([t[1:] for t in tokens], num_threads=1)]
    return [1 if t == " " else n for t, n in zip(tokens, counts, strict=True)]


def _least_count(pieces: DataFrame, most: int) -> int:
    """A frequency that at most ``most`` pre-tokens reach, from a histogram of frequencies (eight steps a doubling)."""
    step = F.floor(F.log2("n") * 8)
    left = most
    for row in sorted(pieces.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            return int(2 ** ((row.step + 1) / 8)) + 1
    return 0


def count_tokens(docs: DataFrame, model_path: str, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row of ``docs`` (columns doc_id, text; others are ignored).

    Distinct pre-tokens are gathered with their frequency and encoded once each. The commonest, at most
    ``hot_tokens`` short ones, are handed to every task, which so adds up most of a text on the spot; the frequencies of the
    others are joined to the counts by a shuffle. No ids are kept. Null and empty texts have 0 bytes and
    0 tokens; repeated rows and null ids give one row each; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def gather(batches):
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"token": list(held), "n": pa.array(held.values(), pa.int64())})

        for batch in portions(batches):
            for text in texts(batch.column(0)):
                held.update(pretokens(text))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def encode(batches):
        model = load_model(model_path)
        for batch in batches:
            pieces = pa.array(piece_counts(model, batch.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["token", "n", "pieces"])

    found = docs.select("text").mapInArrow(gather, "token string, n long")
    vocabulary = found.groupBy("token").agg(F.sum("n").alias("n"))
    pieces = spool(vocabulary.mapInArrow(encode, "token string, n long, pieces long"), "pieces")
    short = pieces.filter(F.length("token") <= HOT_LENGTH)
    hot_rows = short.filter(F.col("n") >= _least_count(short, hot_tokens)).select("token", "pieces").collect()
    hot = spark.sparkContext.broadcast({r.token: r.pieces for r in hot_rows})

    def add_up(batches):
        known = hot.value
        for batch in portions(batches):
            sizes, sums, rare = [], [], []
            for text in texts(batch.column(2)):
                total, others = 0, []
                for token, n in Counter(pretokens(text)).items():
                    count = known.get(token)
                    if count is None:
                        others.append({"token": token, "n": n})
                    else:
                        total += n * count
                sizes.append(len(text.encode()))
                sums.append(total)
                rare.append(others)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(rare, pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))),
                ],
                ["row", "doc_id", "n_bytes", "n_tokens", "rare"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = spool(
        rows.mapInArrow(
            add_up, f"row long, doc_id {kind}, n_bytes long, n_tokens long, rare array<struct<token: string, n: long>>"
        ),
        "parts",
    )
    others = parts.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n")
    counted = others.join(pieces.select("token", "pieces"), "token").groupBy("row").agg(
        F.sum(F.col("n") * F.col("pieces")).alias("n_tokens")
    )
    empty = [F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("n_bytes")]
    both = parts.select("row", "doc_id", "n_bytes", "n_tokens").unionByName(counted.select("row", *empty, "n_tokens"))
    return both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")
    ).drop("row")
