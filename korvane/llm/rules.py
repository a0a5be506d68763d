"""Quality rules whose cutoffs are chosen with a guarantee: risk-controlled thresholds per language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Words, binary_array, bounded_broadcast, discard, materialize, per_text, pieces, release

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: The shares of good documents, in thousandths, that a rule may stand above its cutoff: the candidates of every rule and
#: stratum, from the loosest to the strictest.
PER_MILLE = (0, 2, 4, 6, 8, 10, 13, 16, 20, 25, 30)
#: False rejections of good documents stay below ALPHA in every stratum, with a chance of 1 - DELTA for all strata.
ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Bytes of text that are worked on at a time.
PIECE = 2 << 20

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")


def _in(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


IS_SYMBOL, IS_UPPER = _in(SYMBOLS), _in("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _repeated(words: Words, ids: np.ndarray, n_texts: int) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words found twice or more in the text."""
    n = len(ids) - WINDOW + 1
    if n <= 1:
        return np.zeros(n_texts, np.int64)
    at = np.flatnonzero(words.doc[:n] == words.doc[WINDOW - 1 :])
    key = words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        key ^= ids[at + k].astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93) + (key << np.uint64(6)) + (key >> np.uint64(2))
        key *= np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = at[order[same]], at[order[same + 1]]
    equal = words.doc[a] == words.doc[b]
    for k in range(WINDOW):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():  # two windows share a hash: compare the windows themselves
        seen: dict[tuple, int] = {}
        twice = []
        for i in at.tolist():
            j = seen.setdefault((words.doc[i], *ids[i : i + WINDOW].tolist()), i)
            if j != i:
                twice += [i, j]
        hits = np.array(twice, np.int64)
    else:
        hits = np.concatenate([a, b])
    inside = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        inside[hits + k] = True
    return np.bincount(words.doc[inside], minlength=n_texts)


def _dup_lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word, and those equal to an earlier line."""
    n_texts = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(offsets[1:], ends, "left")  # a line that ends where a text begins is empty and does not count
    keep = data != 10
    kept = np.concatenate([[0], np.cumsum(keep)])
    worded = np.concatenate([[0], np.cumsum(inside)])
    lengths = kept[ends] - kept[starts]
    has_word = worded[ends] > worded[starts]
    ids = binary_array(data[keep], lengths).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc, ids = doc[has_word], ids[has_word]
    lines = np.bincount(doc, minlength=n_texts)
    one = np.unique(doc * (ids.max(initial=0) + 1) + ids) // (ids.max(initial=0) + 1)
    return lines, lines - np.bincount(one, minlength=n_texts)


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of each text."""
    words = Words(data, offsets)
    ids = words.array(data).dictionary_encode().indices.to_numpy().astype(np.int64)
    lines, dup = _dup_lines(data, offsets, words.inside)
    return {
        "n_words": np.diff(words.first_word),
        "word_chars": per_text(words.inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(IS_SYMBOL[data], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": _repeated(words, ids, len(offsets) - 1),
        "n_lines": lines,
        "n_upper": per_text(IS_UPPER[data], offsets),
        "n_exclaim": per_text(data == ord("!"), offsets),
    }


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with STATS of each whole text (null: no words), prefixed ``_r_``."""
    fields = [docs.schema[c] for c in keep] + [T.StructField(f"_r_{s}", T.LongType()) for s in STATS]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        for part, data, offsets in pieces(batches, "_r_text", PIECE):
            stats = text_stats(data, offsets)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *(pa.array(stats[s].astype(np.int64)) for s in STATS)], names=names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_r_text")).mapInArrow(run, schema)


#: Of each rule: two of STATS, how many steps their ratio's unit has, and the ratio's largest step. A document fails a
#: rule if its step is above the cutoff of its stratum.
RULES = {
    "symbol_ratio": ("n_symbols", "n_words", 1000, 10_000),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1000, 1000),
    "upper_ratio": ("n_upper", "word_chars", 1000, 1000),
    "exclaim_ratio": ("n_exclaim", "n_words", 1000, 10_000),
    "mean_word": ("word_chars", "n_words", 10, 10_000),
}
#: Configurations are tried in this order: at each level, one rule after the other goes to the level's candidate.
N_STEPS = len(PER_MILLE) * len(RULES)


def rule_steps() -> list[Column]:
    """A document's whole step under each rule, in the order of RULES."""
    return [F.expr(f"least({most}L, ({unit}L * _r_{a}) div greatest(_r_{b}, 1L))") for a, b, unit, most in RULES.values()]


def base_failed() -> Column:
    return (F.col("_r_n_words") < MIN_WORDS) | (100 * F.col("_r_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_r_n_words"))


def first_step(steps: Column, cuts: Column) -> Column:
    """The first configuration that rejects a document with these ``steps``, N_STEPS if none does; ``cuts`` has the
    cutoff of configuration level * len(RULES) + rule at that place."""
    n = len(RULES)
    fails = F.transform(cuts, lambda c, i: F.when(F.get(steps, (i % n).cast("int")) > c, i).otherwise(N_STEPS))
    return F.coalesce(F.array_min(fails), F.lit(N_STEPS)).cast("int")


def stratum() -> Column:
    """Documents are judged by language; null and empty are one stratum."""
    return F.coalesce(F.col("lang"), F.lit(""))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Chance of k or fewer of n, each with chance p: the exact test that the true rate is below p. Terms are added from
    the largest one down until they no longer count."""
    if k >= n:
        return 1.0
    top = min(k, int((n + 1) * p))
    largest = math.exp(math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p))
    total, odds = [largest], p / (1 - p)
    for places, ratio in ((range(top, 0, -1), lambda i: i / ((n - i + 1) * odds)), (range(top + 1, k + 1), lambda i: (n - i + 1) / i * odds)):
        term = largest
        for i in places:
            term *= ratio(i)
            total.append(term)
            if term < largest * 1e-18:
                break
    return math.fsum(total)


def certify(counts: list[int], n_strata: int, alpha: float, delta: float) -> int:
    """The last configuration that is certified, -1 if none. counts[i]: good holdouts first rejected by configuration i;
    the last entry: those that none rejects.

    Configurations are tested in their fixed order until one fails: so those of a stratum need no further correction, and
    Bonferroni's over the strata holds the chance of any wrong certificate below delta.
    """
    n, rejected, best = sum(counts), 0, -1
    for step in range(len(counts) - 1):
        rejected += counts[step]
        if n == 0 or binomial_tail(rejected, n, alpha) > delta / n_strata:
            break
        best = step
    return best


def candidates(held: DataFrame) -> DataFrame:
    """(stratum, cuts) for ``held`` (stratum, steps): for each configuration its rule's cutoff, the least step of a good
    document that the allowed share of them, or less, stands above.

    Documents are counted by step first, so what is sorted is at most a rule's number of steps for each stratum.
    """
    counts = held.select("stratum", F.posexplode("steps").alias("rule", "step")).groupBy("stratum", "rule", "step").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("stratum", "rule")
    above = F.sum("c").over(own.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    ranked = counts.withColumns({"above": above, "n": F.sum("c").over(own)})
    least = [F.min(F.when(1000 * F.col("above") <= share * F.col("n"), F.col("step"))) for share in PER_MILLE]
    per_rule = ranked.groupBy("stratum", "rule").agg(F.array(*least).alias("levels"))
    lists = per_rule.groupBy("stratum").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "levels"))), lambda x: x["levels"]).alias("rules"))
    place = F.transform(F.sequence(F.lit(0), F.lit(N_STEPS - 1)), lambda i: F.get(F.get("rules", i % len(RULES)), F.floor(i / len(RULES)).cast("int")))
    return lists.select("stratum", place.alias("cuts"))


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, level, cuts): the last certified configuration of each stratum with good holdouts that pass the base
    rules, and all of its candidates.

    ``stats``: doc_id, lang and STATS. Holdouts are the rows of ``labels`` with quality 1; a document labelled more
    than once counts once and is good if any label says so. Holdouts of even doc_ids give the candidates, those of odd
    ones the certificates, so no document does both. A configuration is certified if an exact binomial test rejects that
    it would reject a share of ``alpha`` or more of a stratum's good documents, all rules together. The counts cover all
    holdouts; a stratum leaves one row of N_STEPS + 1 counts. A stratum without even ones has no certificate.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_g_id")).distinct()
    held = stats.where(~base_failed()).join(good, F.col("doc_id") == F.col("_g_id"), "left_semi")
    held = materialize(held.select("doc_id", stratum().alias("stratum"), F.array(*rule_steps()).alias("steps")), "rules-held")
    is_odd = F.col("doc_id").bitwiseAND(F.lit(1).cast(stats.schema["doc_id"].dataType)) == 1
    cuts = materialize(candidates(held.where(~is_odd)), "rules-candidates").withColumnRenamed("stratum", "c_stratum")
    tested = held.where(is_odd).join(bounded_broadcast(cuts), F.col("stratum") == F.col("c_stratum"), "left")
    firsts = tested.select("stratum", F.when(F.col("cuts").isNotNull(), first_step(F.col("steps"), F.col("cuts"))).alias("at"))
    per_step = firsts.groupBy("stratum").agg(*[F.count(F.when(F.col("at") == i, 1)).alias(f"c{i}") for i in range(N_STEPS + 1)])
    strata = held.select("stratum").distinct()
    all_strata = strata.join(per_step.withColumnRenamed("stratum", "p_stratum"), F.col("stratum") == F.col("p_stratum"), "left").drop("p_stratum")
    numbered = all_strata.withColumn("n_strata", F.count(F.lit(1)).over(Window.partitionBy()))  # a row for each stratum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            levels = [certify([r[f"c{i}"] or 0 for i in range(N_STEPS + 1)], r["n_strata"], alpha, delta) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["stratum"] for r in rows], pa.string()), pa.array(levels, pa.int32())], names=["stratum", "level"])

    levels = numbered.mapInArrow(run, "stratum string, level int")
    out = materialize(levels.join(cuts, F.col("stratum") == F.col("c_stratum"), "left").select("stratum", "level", "cuts"), "rules-cutoffs")
    discard(held)
    return out


def judge(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """``stats`` with ``_r_level`` (its stratum's configuration; -1: nothing is certified there, so only the base rules
    hold), ``_r_base_failed`` and ``_r_kept``."""
    n = len(RULES)
    place = [F.col("level") - F.pmod(F.col("level") - r, F.lit(n)) for r in range(n)]  # where each rule has last tightened
    at_level = [F.when(p >= 0, F.get("cuts", p)).alias(f"_r_e{r}") for r, p in enumerate(place)]
    cuts = bounded_broadcast(cuts.select(F.col("stratum").alias("_r_stratum"), F.col("level").alias("_r_cut"), *at_level))
    out = stats.join(cuts, stratum() == F.col("_r_stratum"), "left").withColumn("_r_level", F.coalesce("_r_cut", F.lit(-1)))
    passes = F.lit(True)
    for r, step in enumerate(rule_steps()):
        passes = passes & F.coalesce(step <= F.col(f"_r_e{r}"), F.lit(True))
    return out.withColumn("_r_base_failed", base_failed()).withColumn("_r_kept", ~F.col("_r_base_failed") & passes).drop("_r_stratum", "_r_cut", *[f"_r_e{r}" for r in range(n)])


def filter_documents(docs: DataFrame, labels: DataFrame, **risk: float) -> DataFrame:
    """The documents that pass the base rules and their stratum's certified cutoffs; all columns of ``docs`` are kept.

    Null and empty texts have no words, so the base rules reject them. Repeated rows are judged alike. Documents with a
    null doc_id are never holdouts but are judged. With no labels nothing is certified and only the base rules hold. A
    text is worked on whole, alone if it is long; an empty table stays empty; columns may have any names.
    """
    good = bounded_broadcast(materialize(labels.where("quality = 1").select(F.col("doc_id").alias("_g_id")).distinct(), "rules-good"))
    held = docs.join(good, F.col("doc_id") == F.col("_g_id"), "left_semi")
    cuts = cutoffs(with_stats(held, ["doc_id", "lang"]), labels, **risk)
    release(docs.sparkSession)
    wide = docs.withColumn("_r_all", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("lang", "text", "_r_all")
    kept = judge(with_stats(wide, ["lang", "_r_all"]), cuts).where("_r_kept")
    return kept.select(*[F.col("_r_all").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document, with its counts and its stratum's level."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = materialize(with_stats(docs, ["doc_id", "lang"]), "rules-stats")
    out = judge(stats, cutoffs(stats, labels))
    return out.select("doc_id", *[F.col(f"_r_{s}").alias(s) for s in STATS], F.col("_r_level").alias("level"), F.col("_r_base_failed").alias("base_failed"), F.col("_r_kept").alias("kept"))


def _steps_sql() -> str:
    return "[" + ", ".join(f"least({most}, ({unit} * {a}) // greatest({b}, 1))" for a, b, unit, most in RULES.values()) + "]"


ORACLE = rf"""
with t as (select row_number() over () as r, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
g as (select r, i, ws[i:i+4] as gram from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
h as (select r, i from (select r, i, count(*) over (partition by r, gram) as c from g) where c > 1),
p as (select r, count(distinct i + k) as n_repeat_words from h, (values (0), (1), (2), (3), (4)) v(k) group by r),
s as (select r, doc_id, stratum, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(len(ls) as bigint) as n_lines,
        cast(length(regexp_replace(text, '[^A-Z]', '', 'g')) as bigint) as n_upper, cast(length(regexp_replace(text, '[^!]', '', 'g')) as bigint) as n_exclaim
      from w left join p using (r)),
j as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed, {_steps_sql()} as steps from s),
o as (select r, doc_id & 1 as odd, stratum, steps from j where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
b as (select stratum, rule, step, count(*) as c from (select stratum, unnest(range({len(RULES)})) as rule, unnest(steps) as step from o where odd = 0) group by stratum, rule, step),
a as (select *, sum(c) over (partition by stratum, rule order by step desc) - c as above, sum(c) over (partition by stratum, rule) as n from b),
cuts as (select stratum, rule, level * {len(RULES)} + rule as place, min(step) as cut from a, (select unnest(range({len(PER_MILLE)})) as level, unnest({list(PER_MILLE)}) as share) where 1000 * above <= share * n group by stratum, rule, level),
f as (select r, coalesce(min(case when steps[rule + 1] > cut then place end), {N_STEPS}) as first_fail from j join cuts using (stratum) group by r),
n as (select stratum, count(first_fail) as n, (select count(distinct stratum) from o) as strata from o left join f using (r) where odd = 1 group by stratum),
k as (select stratum, level, n, strata, (select count(*) from o join f using (r) where odd = 1 and o.stratum = n.stratum and first_fail <= level) as k from n, range({N_STEPS}) v(level) where n > 0),
e as (select stratum, level, (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) from range(0, k + 1) v(i)) > {DELTA} / strata as fails from k),
c as (select stratum, coalesce(min(case when fails then level end), {N_STEPS}) - 1 as level from e group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclaim, cast(coalesce(level, -1) as integer) as level, base_failed,
  not base_failed and (coalesce(level, -1) < 0 or coalesce(first_fail, {N_STEPS}) > level) as kept
from j left join c using (stratum) left join f using (r)
"""
