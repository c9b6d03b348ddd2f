"""Language identification by Bayesian fusion of text, declaration and address evidence (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, blocks, fresh, maybe_broadcast, saved, small_batches
from .urlrules import url_host

#: Rows of labelled text that the text model is fitted on, about: as many for each language, one at least.
FIT_ROWS = 4000
#: Overlapping trigrams repeat evidence; their log-likelihood counts by this factor.
TEMPER = 1 / 3
#: Pseudo-counts with which every level of the host hierarchy leans on the level above, and of a declaration.
LEAN, DECLARED_LEAN = 5.0, 1.0

# Byte classes: 1-26 for letters, 27-63 for bytes beyond ASCII, 0 for everything else.
_CLASS = np.zeros(256, np.uint32)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37
GRAMS = 1 << 18


def trigrams(t: Texts) -> np.ndarray:
    """The number of the trigram at every byte; 0, which has no weight, where none begins within a text."""
    c = _CLASS[t.bytes]
    out = np.zeros(len(c), np.uint32)
    if len(c) > 2:
        out[:-2] = c[:-2] << np.uint32(12) | c[1:-1] << np.uint32(6) | c[2:]
    ends = t.offsets[1:]
    for back in (1, 2):
        at = ends - back
        out[at[at >= 0]] = 0
    return out


class TextModel:
    """Naive Bayes over byte trigrams: log-probabilities by language.

    ``column`` gives each trigram its column of ``weights``: 0 for none (weight 0), 1 for all that no language has.
    """

    def __init__(self, languages: list[str], weights: np.ndarray, column: np.ndarray):
        self.languages, self.weights, self.column = languages, weights, column

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text: its log-likelihood in each language, and its number of trigrams with a letter."""
        t = Texts(column)
        grams = trigrams(t)
        columns = self.column[grams]
        full = np.flatnonzero(np.diff(t.offsets))
        out, seen = np.zeros((len(t), len(self.languages))), np.zeros(len(t), np.int64)
        if len(full):
            for k, w in enumerate(self.weights):
                out[full, k] = np.add.reduceat(w[columns], t.offsets[full], dtype=np.float64)
            seen[full] = np.add.reduceat((grams > 0), t.offsets[full], dtype=np.int64)
        return out, seen


def primary_tag(label: Column) -> Column:
    """The language of a label or declaration: its first run of letters A-Z and digits in lower case (``zh-Hant``: zh); a label that begins otherwise stands for itself."""
    first = F.lower(F.regexp_extract(label, r"^\s*([A-Za-z0-9]+)", 1))
    return F.when(first != "", first).otherwise(F.lower(F.trim(label)))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", rows: int = FIT_ROWS) -> TextModel:
    """Fit the text model on a bounded sample of labelled rows: about ``rows``, as many for each language, chosen by hash.

    The draw hashes label and text, so reruns agree; copies are drawn all or none and then count once. Every language is in
    the model, however many there are, with the row of its least hash at least. Only trigram
    counts come to the driver, at most 2^18 for each language. Labels count by their ``primary_tag``. Rows without label or text are left out. Without
    any row the model has no language and all text is undetermined.
    """
    small_batches(labelled.sparkSession)
    source = labelled.where(F.col(text_col).isNotNull()).select(primary_tag(F.col(label_col)).alias("lang"), F.col(text_col).alias("text")).where("lang <> ''")
    draw = F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 30))
    share = saved(source.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("texts"), F.min(draw).alias("first")))
    each = max(1, rows // max(1, share.count()))
    drawn = source.join(maybe_broadcast(share), "lang").where(draw <= F.greatest(F.col("first"), F.ceil(F.lit(1 << 30) * F.least(F.lit(1.0), each / F.col("texts")))))
    sample = drawn.select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text"):
                langs = np.array(b.column(0).to_pylist(), object)
                for lang in sorted(set(langs)):
                    grams = trigrams(Texts(b.column(1).filter(pa.array(langs == lang))))
                    ids, n = np.unique(grams[grams > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    found = sample.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, of = np.unique(np.array(found.column("lang").to_pylist(), object), return_inverse=True)
    grams, at = np.unique(found.column("gram").to_numpy(), return_inverse=True)
    counts = np.zeros((len(names), len(grams)))
    counts[of, at] = found.column("n").to_numpy()
    size = counts.sum(axis=1, keepdims=True) + 0.5 * GRAMS
    weights = np.log(np.concatenate([size, np.full_like(size, 0.5), counts + 0.5], axis=1) / size).astype(np.float32)
    column = np.ones(GRAMS, np.int32)
    column[grams], column[0] = np.arange(2, len(grams) + 2), 0
    return TextModel(names.tolist(), weights, column)


def _normal(x: Column) -> Column:
    return F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda s, y: s + y))


def identify(rows: DataFrame, model: TextModel, id_col: str, text_col: str, declared: Column, host: Column) -> DataFrame:
    """The language of each row from three kinds of evidence, each a factor of the posterior.

    Text: the tempered trigram likelihood of the whole text. Declaration: how often rows whose text speaks for a
    language declare this or that one, counted over all rows with pseudo-counts. Host: the share of
    languages among the rows of the host, leaning on its domain (last two labels), that on the address suffix
    (last label), that on all rows; the shares come from grouped aggregations, joined back by host.

    Returns a row for each row: the id, ``host``, ``declared`` (null if unknown to the model), ``letters`` (trigrams with a
    letter), ``lang`` and ``confidence`` (its posterior, rounded to 6 places). Null, empty or letterless texts say nothing:
    they get ``und`` and confidence 0 unless the declaration is known. Null hosts share one host. Repeated rows
    count as often as they occur. An empty table gives no rows.
    """
    n = len(model.languages)
    known = F.array(*[F.lit(x) for x in model.languages]) if n else F.array().cast("array<string>")
    tag = primary_tag(F.coalesce(declared, F.lit("")))
    source = rows.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.when(F.array_contains(known, tag), tag).alias("declared"), F.col(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text"):
                values, seen = model.scores(b.column(3))
                best = np.where(seen > 0, values.argmax(axis=1), -1) if n else np.full(b.num_rows, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * n + 1, n) if n else np.zeros(b.num_rows + 1), pa.int32()), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(seen), lists, pa.array(best, pa.int32())], ["id", "host", "declared", "letters", "logs", "best"])

    scored = saved(source.mapInArrow(score, f"id {rows.schema[id_col].dataType.simpleString()}, host string, declared string, letters long, logs array<double>, best int"))
    if not n:
        return scored.select(F.col("id").alias(id_col), "host", "declared", "letters", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"))

    # Priors: counts of the text's own verdict, from host up to all rows.
    label = F.split("host", r"\.", -1)
    own = [F.sum((F.col("best") == k).cast("long")).cast("double").alias(f"n{k}") for k in range(n)]
    by_host = saved(scored.groupBy("host").agg(*own).withColumns({"domain": F.array_join(F.slice(label, F.greatest(F.size(label) - 1, F.lit(1)), F.lit(2)), "."), "suffix": F.element_at(label, -1)}))
    counts = F.array(*[F.col(f"n{k}") for k in range(n)])
    add = [F.sum(f"n{k}").alias(f"n{k}") for k in range(n)]
    total = [float(x or 0) for x in by_host.agg(*add).first()]
    top = F.array(*[F.lit((x + 1) / (sum(total) + n)) for x in total])

    def lean(on: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda s, y: s + y)
        return F.zip_with(counts, on, lambda c, p: (c + LEAN * p) / (size + LEAN))

    suffixes = by_host.groupBy("suffix").agg(*add).select("suffix", lean(top).alias("up"))
    domains = by_host.groupBy("suffix", "domain").agg(*add).join(maybe_broadcast(suffixes), "suffix").select("domain", lean(F.col("up")).alias("up"))
    hosts = by_host.join(maybe_broadcast(domains), "domain").select("host", lean(F.col("up")).alias("prior"))

    # Declarations: at most languages x languages counts.
    table = np.full((n, n), DECLARED_LEAN / n)
    for r in scored.where("best >= 0 AND declared IS NOT NULL").groupBy("declared", "best").count().collect():
        table[model.languages.index(r["declared"]), r["best"]] += r["count"]
    table /= table.sum(axis=0, keepdims=True)
    says = F.create_map(*[x for k, lang in enumerate(model.languages) for x in (F.lit(lang), F.array(*[F.lit(float(v)) for v in table[k]]))])

    joined = scored.join(maybe_broadcast(hosts), "host", "left")
    flat = F.array(*[F.lit(0.0)] * n)
    word = F.coalesce(F.transform(says[F.col("declared")], lambda p: F.log(p)), flat)
    logs = F.zip_with(F.zip_with(F.transform("logs", lambda x: x * TEMPER), F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), word, lambda a, b: a + b)
    odds = F.transform(F.col("lp"), lambda x: F.exp(x - F.array_max(F.col("lp"))))
    done = joined.withColumn("lp", logs).withColumn("post", _normal(odds)).withColumn("peak", F.array_max("post"))
    mute = (F.col("letters") == 0) & F.col("declared").isNull()
    return done.select(
        F.col("id").alias(id_col), "host", "declared", "letters",
        F.when(mute, F.lit("und")).otherwise(F.element_at(known, F.array_position("post", F.col("peak")).cast("int"))).alias("lang"),
        F.when(mute, F.lit(0.0)).otherwise(F.round("peak", 6)).alias("confidence"),
    )


def keep_identified(docs: DataFrame, least: float = 0.5, text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The documents whose language is settled: they have letters, and one language has a posterior of ``least`` or more."""
    row = fresh(docs, "row__")
    model = fit(docs.select(text_col, lang_col), text_col, lang_col)
    # A row is named by the digest of its content, which any recomputation finds again; equal rows share their verdict.
    named = docs.withColumn(row, F.sha2(F.concat_ws("\x1f", *[F.concat(F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (text_col, lang_col, host_col)]), 256))
    verdicts = identify(named, model, row, text_col, F.col(lang_col), F.col(host_col)).where((F.col("letters") == 0) | (F.col("confidence") < least))
    rejected = maybe_broadcast(verdicts.select(row).distinct())
    return named.join(rejected, row, "left_anti").select(*docs.columns)


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags are gaps."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>", " ")


def html_language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)


def op3_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_text(F.col("html")).alias("text"), html_language(F.col("html")).alias("declared"), url_host(F.col("url")).alias("host"))
    return identify(pages, model, "page_id", "text", F.col("declared"), F.col("host"))
