"""One answer for each group of texts through a tree whose nodes hold as much as a model's window takes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texts import token_estimate
from ..shared import discard, materialize, small
from .asking import MAX_HALVINGS, Overflow, answer_chunk
from .packing import pack
from .semantic import ChatModel

#: A tree that does not end after so many levels never would.
MAX_LEVELS = 64
#: A note, or a text, and how many rows it stands for.
Note = tuple[str | None, int]


def _filled(template: str, texts: list[Note]) -> str:
    return template.replace("{items}", "\n".join(t for t, _ in texts))


def notes_of(texts: list[Note], template: str, model: ChatModel) -> list[Note]:
    """The note of some texts together, or, if the model finds them too long, those of their halves and so on; a text that
    is too long alone is cut. A note without an answer is None."""
    try:
        return [(model.complete([_filled(template, texts)])[0], sum(n for _, n in texts))]
    except Overflow:
        if len(texts) > 1:
            middle = len(texts) // 2
            return notes_of(texts[:middle], template, model) + notes_of(texts[middle:], template, model)
    cut = [a for a in answer_chunk(model, lambda chunk: template.replace("{items}", chunk), texts[0][0], depth=MAX_HALVINGS) if a is not None]
    return [(a, texts[0][1] if i == 0 else 0) for i, a in enumerate(cut)] or [(None, texts[0][1])]


def final_of(texts: list[Note], template: str, final_template: str, model: ChatModel) -> list[Note]:
    """The last answer; if the notes are too long for the model after all, they are noted by halves once more."""
    for _ in range(MAX_LEVELS):
        try:
            return [(model.complete([_filled(final_template, texts)])[0], sum(n for _, n in texts))]
        except Overflow:
            middle = len(texts) // 2
            halves = [texts[:middle], texts[middle:]] if middle else [texts]
            notes = [n for half in halves for n in (notes_of(half, template, model)) if n[0] is not None]
            if not notes or notes == texts:
                break
            texts = notes
    return [(None, sum(n for _, n in texts))]


def _answered(chunks: DataFrame, question: str, singly: Callable[[list[Note]], list[Note]], model: ChatModel) -> DataFrame:
    """Chunks (keys, _chunk, texts in order) as notes (keys, _order, _place, _t, _rows). All chunks of a batch are one
    call, or each goes through ``singly`` if one of them is too long."""
    keep = [f for f in chunks.schema.fields if f.name not in ("_chunk", "texts")]
    schema = T.StructType([*keep, T.StructField("_order", T.LongType()), T.StructField("_place", T.LongType()), T.StructField("_t", T.StringType()), T.StructField("_rows", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = [[(x["_t"], int(x["_rows"])) for x in row] for row in pdf["texts"]]
            try:
                notes = [[(a, sum(n for _, n in x))] for a, x in zip(model.complete([_filled(question, x) for x in lists]), lists)]
            except Overflow:
                notes = [singly(x) for x in lists]
            rows = [i for i, n in enumerate(notes) for _ in n]
            out = pdf.iloc[rows][[f.name for f in keep]].reset_index(drop=True)
            flat = [x for n in notes for x in n]
            yield out.assign(_order=pdf["_chunk"].to_numpy()[rows], _place=[p for n in notes for p in range(len(n))], _t=[t for t, _ in flat], _rows=[n for _, n in flat])

    return chunks.mapInPandas(run, schema)


def _texts() -> Column:
    """The texts of a group of rows in the order of (_order, _place)."""
    return F.transform(F.array_sort(F.collect_list(F.struct("_order", "_place", "_t", "_rows"))), lambda x: F.struct(x["_t"].alias("_t"), x["_rows"].alias("_rows"))).alias("texts")


def _of(level: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``level`` that belong to some groups, a written table."""
    if not keys:
        return level if groups.limit(1).count() else level.where(F.lit(False))
    return level.join(small(groups.select(*keys)), keys, "left_semi")


def reduce_packed(df: DataFrame, text: str, order: str, template: str, final_template: str, model: ChatModel, budget: int, by: list[str] = ()) -> DataFrame:
    """One answer (``result``) for each group of rows with its keys, the number of its ``rows`` and how many of them are
    ``lost``: texts are packed in order into chunks of at most ``budget`` tokens, each chunk is noted (``template``, with
    {items}), notes are packed again, and once a group's notes fit together they are answered by ``final_template``.

    Groups that fit at once get the final question only. A chunk that the model finds too long (Overflow) is halved. Rows
    of a chunk without an answer are lost; a group without any note has a null result. Rows with a null text or key take
    no part; without keys all rows are one group, and no rows give no answer. A group of a third of all rows is packed
    over many tasks; a task asks about whole chunks, whose size the budget bounds.
    """
    keys = list(by)
    level = df.where(F.col(text).isNotNull())
    level = level.dropna(subset=keys) if keys else level
    level = level.select(*keys, F.col(f"`{order}`").alias("_order"), F.lit(0).cast("long").alias("_place"), F.col(f"`{text}`").alias("_t"), F.lit(1).cast("long").alias("_rows"))
    level = materialize(level, "reduce-level")
    sizes = materialize(level.groupBy(*keys).agg(F.sum("_rows").alias("rows")).where("rows > 0"), "reduce-sizes")
    finished = []
    for _ in range(MAX_LEVELS):
        totals = level.groupBy(*keys).agg(F.sum(token_estimate(F.col("_t"))).alias("_total"), F.count(F.lit(1)).alias("_n")).where("_n > 0")
        totals = materialize(totals.withColumn("_fits", (F.col("_total") <= budget) | (F.col("_n") == 1)), "reduce-totals")
        whole = _of(level, totals.where("_fits"), keys).groupBy(*keys).agg(_texts()).where(F.size("texts") > 0).withColumn("_chunk", F.lit(0).cast("long"))
        last = _answered(whole, final_template, lambda x: final_of(x, template, final_template, model), model)
        finished.append(materialize(last.select(*keys, F.col("_t").alias("result"), "_rows"), "reduce-done"))
        more = totals.where("not _fits")
        if not more.limit(1).count():
            break
        packed = pack(_of(level, more, keys), keys, ["_order", "_place"], token_estimate(F.col("_t")), budget)
        notes = _answered(packed.groupBy(*keys, "_chunk").agg(_texts()), template, lambda x: notes_of(x, template, model), model)
        before, level = level, materialize(notes.where("_t is not null"), "reduce-level")
        discard(before, packed)
    else:
        raise RuntimeError(f"no end after {MAX_LEVELS} levels: the notes don't get shorter")
    done = finished[0]
    for f in finished[1:]:
        done = done.unionByName(f)
    done = done.select(*[F.col(f"`{k}`").alias(f"_f{i}") for i, k in enumerate(keys)], "result", F.when(F.col("result").isNotNull(), F.col("_rows")).otherwise(0).alias("_kept"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(f"`{k}`") == F.col(f"_f{i}"))
    out = sizes.join(done if keys else F.broadcast(done), same, "left")  # without keys, one row
    return out.select(*keys, "result", "rows", (F.col("rows") - F.coalesce("_kept", F.lit(0))).alias("lost"))
