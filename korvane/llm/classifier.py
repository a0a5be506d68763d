"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model reads the characters of a text as they are, any code point; its tables grow with the trusted text and are
never held by one worker or the driver. Tasks count n-grams, shards of (language, n-gram) add them up, and joins of the
sharded counts give the log probability of every n-gram that the scored documents hold. Documents are scored in blocks:
a block's distinct n-grams are joined with the sharded log probabilities, and what that gives meets the block's texts
again. A document's perplexity is compared with a quantile of trusted documents of its language that the model has not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_broadcast, discard, materialize, release

#: Characters of an n-gram.
ORDER = 5
#: Documents above this quantile of their language's held-out documents are rejected, with some room above it.
QUANTILE, MARGIN = 0.995, 1.05
#: One in so many trusted documents is not counted and sets the thresholds instead.
HELD_OUT = 8
#: A document's perplexity counts so many symbols at its language's mean besides its own, so short texts decide less.
PRIOR_SYMBOLS = 40
#: Bins of nats a symbol in which quantiles are found.
BIN, MAX_BINS = 0.002, 20_000
#: Bytes of text in a block, characters that Python works on at a time, and passes over the documents: the shuffled
#: texts of one pass are on disk at a time.
BLOCK, PIECE, PASSES = 8 << 20, 1 << 20, 4
#: Stands before a text's first character; a NUL in a text counts as NUL.
PAD, NUL = "\u0002", "\ufffd"
#: The model of all languages, for those without trusted text.
POOLED = "\u0001"


def segments(texts: list[str | None], order: int = ORDER, piece: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """Lists of (text number, order - 1 characters before and then the characters to predict), of about ``piece``
    characters a list. Longer texts are split, so no list is much longer, and no character is lost."""
    docs, parts, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        padded = PAD * (order - 1) + text.replace("\0", NUL)
        for at in range(0, len(text), piece):
            docs.append(i)
            parts.append(padded[at : at + piece + order - 1])
            size += len(parts[-1])
            if size >= piece:
                yield docs, parts
                docs, parts, size = [], [], 0
    if docs:
        yield docs, parts


def grams(docs: list[int], parts: list[str], order: int = ORDER) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the distinct n-grams of a list of ``segments``, which of them ends at each character, the character's text)."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) - order + 1 for p in parts])
    at = np.arange(lengths.sum()) + np.repeat(np.arange(len(parts)) * (order - 1), lengths)
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)  # tables as long as the text needs stay in a core's cache
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.uint32)
    place[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    local, bits = place[codes], max(1, len(alphabet).bit_length())
    n = len(codes) - order + 1  # a number for each place, those across two parts too
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        if (k + 1) * bits > 63 and k * bits <= 63:  # too many characters for one number: number what there is so far
            key = pd.factorize(key)[0].astype(np.uint64)
            bits = 21
        key <<= np.uint64(bits)
        key |= local[k : k + n]
    coded = pa.array(key[at]).dictionary_encode()
    which, distinct = coded.indices.to_numpy(), coded.dictionary
    first = np.zeros(len(distinct), np.int64)
    first[which[::-1]] = at[::-1]
    letters = np.ascontiguousarray(codes[first[:, None] + np.arange(order)]).view(f"<U{order}").ravel()
    return pa.array(letters, pa.string()), which, np.repeat(np.array(docs), lengths)


def by_language(langs: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    coded = langs.dictionary_encode()
    which = coded.indices.to_numpy()
    for k, name in enumerate(coded.dictionary.to_pylist()):
        yield name, np.flatnonzero(which == k)


def language_of(lang: Column) -> Column:
    """Null and empty are one language."""
    return F.coalesce(lang, F.lit(""))


def language() -> Column:
    return language_of(F.col("lang"))


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each n-gram stands in ``docs`` (lang, text), over whole texts."""
    order, piece = ORDER, PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lang, rows in by_language(batch.column(0)):
                for part in segments([texts[i] for i in rows.tolist()], order, piece):
                    gram, which, _ = grams(*part, order)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), gram, pa.array(np.bincount(which, minlength=len(gram)))], names=["lang", "gram", "n"])

    per_piece = docs.select(language().alias("lang"), F.col("text").alias("_q_text")).mapInArrow(run, "lang string, gram string, n long")
    return per_piece.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def held_out(row: Column) -> Column:
    """Whether a trusted document with this ``row_hash`` sets thresholds instead of being counted."""
    return F.pmod(F.xxhash64(row, F.lit("held out")), F.lit(HELD_OUT)) == 0


class Counts:
    """The sharded counts of trusted text: for each length of n-grams a written table (model, gram, n), and the
    discounts (model, length, d1, d2, d3, letters) of all of them. A model is a language or POOLED.

    The longest n-grams have counts, shorter ones the number of different characters seen before them. Discounts D1, D2
    and D3+ come from the numbers of n-grams seen once to four times, kept within 0.05 and their count less 0.05; half
    of the count where those numbers are 0.
    """

    def __init__(self, trusted: DataFrame, pooled: bool = True) -> None:
        own = count_grams(trusted).select(F.col("lang").alias("model"), "gram", "n")
        if pooled:
            own = materialize(own, "kn-own")
            own = own.unionByName(own.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("model"), "gram", "n"))
        self.levels = {ORDER: materialize(own, "kn-counts")}
        for length in range(ORDER - 1, 0, -1):
            longer = self.levels[length + 1]
            self.levels[length] = materialize(longer.groupBy("model", F.substring("gram", 2, length).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "kn-counts")
        once = None
        for length, level in self.levels.items():
            n = level.groupBy("model").agg(F.count(F.lit(1)).alias("letters"), *[F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]).withColumn("length", F.lit(length))
            once = n if once is None else once.unionByName(n)
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        step = {i: F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * i)))) for i in (1, 2, 3)}
        self.discounts = materialize(once.select("model", "length", "letters", *[s.alias(f"d{i}") for i, s in step.items()]), "kn-discounts")
        self.few = bounded_broadcast(self.discounts)
        release(trusted.sparkSession)

    def contexts(self, length: int) -> DataFrame:
        """(c_model, context, total, d1, d2, d3, weight): what is spared for shorter n-grams after each context."""
        level = self.levels[length]
        out = level.groupBy("model", F.substring("gram", 1, length - 1).alias("context")).agg(
            F.sum("n").alias("total"), *[F.count(F.when(F.col("n") == i if i < 3 else F.col("n") >= 3, 1)).alias(f"c{i}") for i in (1, 2, 3)]
        )
        d = self.few.where(F.col("length") == length).select(F.col("model").alias("d_model"), "d1", "d2", "d3")
        out = out.join(d, F.col("model") == F.col("d_model"))
        weight = (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total")
        return out.select(F.col("model").alias("c_model"), "context", "total", "d1", "d2", "d3", weight.alias("weight"))

    def log_probabilities(self, needed: DataFrame) -> DataFrame:
        """(model, gram, nats), a written table: -log of the probability of each n-gram's last character after the
        others, for the distinct n-grams ``needed`` (model, gram). Below single characters, all characters of a model's
        trusted text and one more are alike.

        Tables of n-grams are joined by sorted shards at every size, so none of them comes to the driver to be sent."""
        short = materialize(needed.select("model", F.substring("gram", 2, ORDER - 1).alias("gram")).distinct(), "kn-needs")
        needs = {ORDER: needed, ORDER - 1: short}
        for length in range(ORDER - 2, 0, -1):
            needs[length] = needs[length + 1].select("model", F.substring("gram", 2, length).alias("gram")).distinct()
        letters = self.few.where("length = 1").select(F.col("model").alias("v_model"), "letters")
        lower, written = None, [short]
        for length in range(1, ORDER + 1):
            own = self.levels[length].select(F.col("model").alias("o_model"), F.col("gram").alias("o_gram"), "n").hint("merge")
            out = needs[length].join(own, (F.col("model") == F.col("o_model")) & (F.col("gram") == F.col("o_gram")), "left")
            out = out.withColumn("head", F.substring("gram", 1, length - 1))
            out = out.join(self.contexts(length).hint("merge"), (F.col("model") == F.col("c_model")) & (F.col("head") == F.col("context")), "left")
            if lower is None:
                out = out.join(letters, F.col("model") == F.col("v_model"), "left").withColumn("below", 1 / (1 + F.coalesce("letters", F.lit(0))))
            else:
                below = lower.select(F.col("model").alias("s_model"), F.col("gram").alias("s_gram"), F.col("p").alias("below")).hint("merge")
                out = out.withColumn("tail", F.substring("gram", 2, length - 1)).join(below, (F.col("model") == F.col("s_model")) & (F.col("tail") == F.col("s_gram")))
            cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
            share = F.coalesce((F.col("n") - cut) / F.col("total"), F.lit(0.0))
            lower = out.select("model", "gram", (share + F.coalesce("weight", F.lit(1.0)) * F.col("below")).alias("p"))
            if length >= ORDER - 2:
                lower = materialize(lower, "kn-p")
                written.append(lower)
                release(lower.sparkSession)
        discard(*written[:-1])
        return lower.select("model", "gram", (-F.log("p")).alias("nats"))


def score(docs: DataFrame, counts: Counts, keep: list[str]) -> DataFrame:
    """A written table of _q_all (the columns ``keep``), _q_hash (``row_hash``), _q_nats (the sum of -log probabilities)
    and _q_symbols of each whole text. Null and empty texts have no symbols.

    A language's texts are dealt out to blocks of about BLOCK bytes by the row's hash, so copies of one text with ids of
    their own spread out; rows that are the same in all of it spread by the task that reads them. ``docs`` must be a
    scan of files, which gives its rows to the same tasks each time it is read.
    """
    trained = counts.discounts.where(F.col("length") == 1).select(F.col("model").alias("t_model"))
    sizes = docs.groupBy(language().alias("z_lang")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    sizes = sizes.join(trained, F.col("z_lang") == F.col("t_model"), "left")
    blocks = F.ceil(F.coalesce("bytes", F.lit(0)) / (BLOCK * PASSES)) + 1
    sizes = bounded_broadcast(materialize(sizes.select("z_lang", F.coalesce("t_model", F.lit(POOLED)).alias("z_model"), blocks.alias("z_blocks")), "kn-sizes"))
    others = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = docs.select(language().alias("_q_lang"), others.alias("_q_all"), F.col("text").alias("_q_text"), row_hash().alias("_q_hash"), F.spark_partition_id().alias("_q_task"))
    rows = rows.join(sizes, F.col("_q_lang") == F.col("z_lang"))
    block = F.pmod(F.xxhash64("_q_hash", "_q_task"), F.col("z_blocks"))
    out_schema = T.StructType([T.StructField("_q_all", rows.schema["_q_all"].dataType), T.StructField("_q_hash", T.LongType()), T.StructField("_q_nats", T.DoubleType()), T.StructField("_q_symbols", T.LongType())])
    names, order, piece = out_schema.names, ORDER, PIECE

    def held(table: pa.Table) -> pa.Table:
        found = [grams(*part, order)[0] for part in segments(table["_q_text"].to_pylist(), order, piece)]
        gram = pc.unique(pa.chunked_array(found, pa.string()))
        return pa.table({"_q_lang": pa.array([table["_q_lang"][0].as_py()] * len(gram), pa.string()), "_q_block": pa.array([table["_q_block"][0].as_py()] * len(gram), pa.int64()), "gram": gram, "z_model": pa.array([table["z_model"][0].as_py()] * len(gram), pa.string())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sums, size = np.zeros(left.num_rows), np.zeros(left.num_rows, np.int64)
        known, value = right["g_gram"].combine_chunks(), right["nats"].to_numpy()
        for part in segments(left["_q_text"].to_pylist(), order, piece):
            gram, which, doc = grams(*part, order)
            at = pc.index_in(gram, value_set=known)
            if at.null_count:
                raise ValueError("the documents changed while they were read")
            sums += np.bincount(doc, value[at.to_numpy()][which], left.num_rows)
            size += np.bincount(doc, minlength=left.num_rows)
        return left.select(names[:-2]).append_column("_q_nats", pa.array(sums)).append_column("_q_symbols", pa.array(size))

    parts = [rows.where(F.pmod("_q_hash", F.lit(PASSES)) == k).withColumn("_q_block", block).select("_q_lang", "_q_block", "z_model", "_q_all", "_q_hash", "_q_text") for k in range(PASSES)]
    texts = [part.select("_q_lang", "_q_block", "z_model", "_q_text") for part in parts]
    asked = [materialize(t.groupBy("_q_lang", "_q_block").applyInArrow(held, "_q_lang string, _q_block long, gram string, z_model string"), "kn-asked") for t in texts]
    needed = asked[0]
    for a in asked[1:]:
        needed = needed.unionByName(a)
    needed = materialize(needed.select(F.col("z_model").alias("model"), "gram").distinct(), "kn-needed")
    release(docs.sparkSession)
    nats = counts.log_probabilities(needed)
    discard(needed)
    out = None
    for part, a in zip(parts, asked):
        told = a.join(nats.withColumnRenamed("gram", "m_gram").hint("merge"), (F.col("z_model") == F.col("model")) & (F.col("gram") == F.col("m_gram")))
        told = told.select(F.col("_q_lang").alias("g_lang"), F.col("_q_block").alias("g_block"), F.col("gram").alias("g_gram"), "nats")
        scored = part.groupBy("_q_lang", "_q_block").cogroup(told.groupBy("g_lang", "g_block")).applyInArrow(run, out_schema)
        scored = materialize(scored, "kn-scores")
        discard(a)
        release(docs.sparkSession)
        out = scored if out is None else out.unionByName(scored)
    return out


class Classifier:
    """A model of the trusted ones among ``docs``, the scores of all ``docs`` and the thresholds of their languages."""

    def __init__(self, docs: DataFrame, labels: DataFrame, keep: list[str], quantile: float = QUANTILE, margin: float = MARGIN) -> None:
        """One trusted document in HELD_OUT, by the hash of its row, sets thresholds; all the others are counted."""
        ids = trusted_ids(labels)
        trusted = docs.select("doc_id", "lang", "text").join(bounded_broadcast(ids), F.col("doc_id") == F.col("g_id"), "left_semi").where(~held_out(row_hash()))
        self.counts = Counts(trusted, needs_pooled(docs, trusted))
        self.scores = score(docs, self.counts, [*dict.fromkeys(["doc_id", "lang", *keep])])
        known = self.scores.where(held_out(F.col("_q_hash")) & (F.col("_q_symbols") > 0)).select(F.col("_q_all.doc_id").alias("doc_id"), language_of(F.col("_q_all.lang")).alias("lang"), "_q_nats", "_q_symbols")
        known = materialize(known.join(bounded_broadcast(ids), F.col("doc_id") == F.col("g_id"), "left_semi").drop("doc_id"), "kn-held")
        nats = F.round(F.sum("_q_nats") / F.sum("_q_symbols"), 9)
        self.means = materialize(known.groupBy("lang").agg(nats.alias("mean")).withColumnRenamed("lang", "m_lang"), "kn-means")
        self.all_mean = known.agg(nats).first()[0] or 0.0
        rated = self.rate(known)
        bins = rated.groupBy("lang", F.least(F.floor(F.col("_q_rate") / BIN), F.lit(MAX_BINS)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))  # MAX_BINS rows a language at most
        cut = bins.where(F.col("upto") >= F.col("all") * quantile).groupBy("lang").agg(F.min("bin").alias("bin"))
        self.cuts = materialize(cut.select(F.col("lang").alias("t_lang"), ((F.col("bin") + 1) * BIN * margin).alias("cut")), "kn-cuts")
        loosest = self.cuts.agg(F.max("cut")).first()[0]
        self.all_cut = float("inf") if loosest is None else loosest

    def rate(self, scores: DataFrame) -> DataFrame:
        """``scores`` (lang, _q_nats, _q_symbols) with _q_rate: nats a symbol, drawn to the language's mean by
        PRIOR_SYMBOLS symbols."""
        out = scores.join(bounded_broadcast(self.means), F.col("lang") == F.col("m_lang"), "left")
        mean = F.coalesce("mean", F.lit(self.all_mean))
        return out.withColumn("_q_rate", (F.col("_q_nats") + PRIOR_SYMBOLS * mean) / (F.col("_q_symbols") + PRIOR_SYMBOLS)).drop("m_lang", "mean")

    def verdicts(self) -> DataFrame:
        """_q_all (doc_id, lang and ``keep``), _q_hash, _q_symbols, _q_perplexity, _q_threshold, _q_kept.

        Null and empty texts have no symbols and are rejected. A language without trusted text is judged by the model
        of all languages, one without held-out text by the loosest threshold and the mean of all; with no trusted text
        at all, every text with symbols is kept. Repeated rows are judged alike; null ids count as ids.
        """
        rated = self.rate(self.scores.withColumn("lang", language_of(F.col("_q_all.lang"))))
        rated = rated.join(bounded_broadcast(self.cuts), F.col("lang") == F.col("t_lang"), "left")
        cut = F.coalesce("cut", F.lit(self.all_cut))
        rated = rated.withColumn("_q_kept", (F.col("_q_symbols") > 0) & (F.col("_q_rate") <= cut))
        return rated.withColumn("_q_perplexity", F.exp("_q_rate")).withColumn("_q_threshold", F.exp(cut)).drop("lang", "t_lang", "cut", "_q_nats", "_q_rate")


def needs_pooled(docs: DataFrame, counted: DataFrame) -> bool:
    """Whether some language of ``docs`` is without counted text."""
    langs = counted.where(F.length("text") > 0).select(language().alias("k_lang")).distinct()
    return not docs.select(language().alias("lang")).distinct().join(langs, F.col("lang") == F.col("k_lang"), "left_anti").isEmpty()


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(g_id), a written table: documents that a label calls good and none calls bad or toxic. Null ids never are."""
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0")
    return materialize(ids.select(F.col("doc_id").alias("g_id")), "kn-ids")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose perplexity stays within their language's threshold; all columns are kept, whatever their names.

    Texts stay where they are, the rejected rows' 128-bit keys come to them. Null and empty texts are rejected, repeated
    rows judged alike; a text of any length is scored whole, in pieces. An empty table stays empty; without labels every
    text with a character is kept."""
    second = F.xxhash64(F.lit("second"), "doc_id", "lang", "text")
    verdicts = Classifier(docs.select("doc_id", "lang", "text", second.alias("_q_second")), labels, ["_q_second"]).verdicts()
    rejected = materialize(verdicts.where("not _q_kept").select(F.col("_q_hash").alias("r_hash"), F.col("_q_all._q_second").alias("r_second")).distinct(), "kn-rejected")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_all"), row_hash().alias("_q_hash"), second.alias("_q_second"))
    kept = whole.join(bounded_broadcast(rejected), (F.col("_q_hash") == F.col("r_hash")) & (F.col("_q_second") == F.col("r_second")), "left_anti")
    return kept.select(*[F.col("_q_all").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity, its language's threshold and the verdict."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = Classifier(docs, labels, []).verdicts()
    return out.select("_q_all.doc_id", "_q_all.lang", F.col("_q_symbols").alias("symbols"), F.col("_q_perplexity").alias("perplexity"), F.col("_q_threshold").alias("threshold"), F.col("_q_kept").alias("kept"))
