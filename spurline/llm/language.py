"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spurline.llm.common import keep, slices
from spurline.llm.urls import host_of

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
MARKUP = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[a-z/!?][^>]*(?:>|\Z)")
#: Words of a text that are read at a time.
_LONG = 30_000


@dataclass(frozen=True)
class Settings:
    """bits: of the hashed n-grams of bytes. unseen: an n-gram that a language's rows lack speaks against it so many times to one at most. rows: about how many declared rows of each language the
    likelihoods are fitted to, drawn by hash. least_rows: a language needs so many declared rows, of however many.
    temper: overlapping n-grams say the same thing this many times. host, domain, suffix: rows that the
    next wider level of the host prior counts for. sure: the least posterior of an accepted row."""

    bits: int = 16
    unseen: float = 4.0
    rows: int = 20_000
    least_rows: int = 5
    temper: float = 3.0
    host: float = 5.0
    domain: float = 20.0
    suffix: float = 100.0
    sure: float = 0.5


@dataclass(frozen=True)
class Likelihoods:
    """names: the languages, then UNKNOWN; table: log P(n-gram | language), one row for each n-gram, held from below as fit() says."""

    names: tuple[str, ...]
    table: np.ndarray


def grams(text: str | None, bits: int) -> Iterator[np.ndarray]:
    """Hashed trigrams of the bytes of the lower-cased letters of a text, words parted by one space; none without letters.

    A long text comes in pieces of _LONG words; each starts with the two bytes before it, so no trigram is lost between them.
    """
    found, before = WORD.finditer((text or "").lower()), b" "
    while words := [m[0] for m in itertools.islice(found, _LONG)]:
        joined = before + f"{' '.join(words)} ".encode("utf-8", "replace")
        before = joined[-2:]
        b = np.frombuffer(joined, dtype=np.uint8).astype(np.uint32)
        codes = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        yield (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def visible(page: str | None) -> str:
    """The text of a page without scripts, styles, comments and tags."""
    return html.unescape(MARKUP.sub(" ", page or ""))


def subtag(declared: Column) -> Column:
    """The primary subtag of a declared language, lower-cased; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,8})(?![A-Za-z])", 1)), F.lit(""))


def declared_in(page: Column) -> Column:
    """The lang attribute of the html element."""
    return F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z-]+)", 1)


def fit(docs: DataFrame, s: Settings = Settings()) -> Likelihoods:
    """Fits likelihoods to docs (doc_id, text, lang) by their declared languages, on all rows of a language or about s.rows drawn by hash.

    Rows without a declared language are left out. UNKNOWN takes every n-gram as equally likely, at 2**-s.bits. A language holds an n-gram
    that its rows have for no less likely than that, and one that they lack for no less than that / s.unseen, so that short texts of a language aren't
    taken for none of them because of rare words. A likelihood is of its own language's rows alone, so the shares of the languages, drawn or not, have no part in it. The counts that come
    to the driver are at most 2**s.bits for each language.
    """
    named = docs.select("doc_id", F.col("text").cast("string").alias("text"), subtag(F.col("lang").cast("string")).alias("lang")).where("lang is not null and text is not null")
    there = sorted((r["lang"], r["count"]) for r in named.groupBy("lang").count().where(F.col("count") >= s.least_rows).collect())
    names = tuple(n for n, _ in there)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in slices(batches, "text", 500):
            for lang, text in zip(batch.column("at").to_pylist(), batch.column("text")):
                for codes in grams(text.as_py(), s.bits):
                    counts.setdefault(lang, np.zeros(2**s.bits, dtype=np.int64))
                    counts[lang] += np.bincount(codes, minlength=2**s.bits)
        for lang, n in counts.items():
            gram = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang, dtype=np.int32)), pa.array(gram.astype(np.int32)), pa.array(n[gram])], ["lang", "gram", "n"])

    counts = np.zeros((2**s.bits, len(names) + 1))
    if names:
        spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_007))
        parts = docs.sparkSession.createDataFrame([(n, i, int(1_000_000_007 * min(1.0, s.rows / k))) for i, (n, k) in enumerate(there)], "lang string, at int, below long")
        drawn = named.join(F.broadcast(parts), "lang").where(spread < F.col("below"))
        got = drawn.select("at", "text").mapInArrow(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        np.add.at(counts, (got["gram"].to_numpy(), got["lang"].to_numpy()), got["n"].to_numpy())
    least = np.where(counts > 0, 1.0, 1 / s.unseen) / 2**s.bits
    least[:, -1] = 2.0**-s.bits
    return Likelihoods((*names, UNKNOWN), np.log(np.maximum((counts + 1) / (counts + 1).sum(axis=0), least)).astype(np.float32))


def evidence(rows: DataFrame, model: Likelihoods, s: Settings = Settings()) -> DataFrame:
    """Replaces text of rows by likelihood, an array in the order of model.names, and letters: whether it has any.

    rows: text, is_page, and any further columns.
    """
    sent, others = rows.sparkSession.sparkContext.broadcast(model.table), [c for c in rows.columns if c not in ("text", "is_page")]
    width = len(model.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in slices(batches, "text", 500):
            likely, letters = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows, dtype=bool)
            for k, (text, is_page) in enumerate(zip(batch.column("text"), batch.column("is_page").to_pylist())):
                for codes in grams(visible(text.as_py()) if is_page else text.as_py(), s.bits):
                    likely[k] += table[codes].sum(axis=0, dtype=np.float64)
                    letters[k] = True
            offsets = pa.array(np.arange(0, likely.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.ListArray.from_arrays(offsets, pa.array(likely.ravel() / s.temper)), pa.array(letters)], [*others, "likelihood", "letters"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    return rows.select(*others, "text", "is_page").mapInArrow(run, f"{fields}, likelihood array<double>, letters boolean")


def _widened(level: DataFrame, wider: DataFrame, by: str, weight: float) -> DataFrame:
    """Replaces counts of level (names, n, by) by shares, smoothed with those of the wider level."""
    joined = level.join(wider.select(F.col(by).alias("wider"), F.col("share").alias("of_wider")), F.col(by).eqNullSafe(F.col("wider")))
    share = F.expr(f"zip_with(n, of_wider, (x, p) -> (x + {weight} * p) / (aggregate(n, 0D, (a, y) -> a + y) + {weight}))")
    return joined.withColumn("share", share).drop("wider")


def identify(rows: DataFrame, model: Likelihoods, s: Settings = Settings(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of rows (text, is_page, declared, host): text_lang, lang, posterior, accepted, and the columns in carry.

    text_lang is the language that the text alone makes likeliest, null without letters. The posterior of a language multiplies

    - the likelihood of the text, a page's without its markup,
    - the chance that rows whose text is of this language declare what this one declares, counted over all rows
      (another language than the model's counts as one value, none as another),
    - the prior of the host: the share of the language among the texts of the host, smoothed with that of its
      domain (last two labels), that with its address suffix (last label), that with all rows.
      The row's own text is left out of its host's counts. A host without dots has no domain and suffix of its own.

    lang is the likeliest. A row is accepted if that is a language of the model, its posterior at least s.sure, and
    the text has letters: null, empty and letterless texts get the language of the other evidence and are not accepted. Null hosts are one host.
    Rows may repeat. Counts are grouped aggregations over all rows; the join of rows with their hosts moves only likelihoods, not texts.
    """
    k = len(model.names)
    known = F.array(*map(F.lit, model.names[:-1])) if k > 1 else F.array().cast("array<string>")
    declared = F.when(F.col("declared").isNull(), k).otherwise(F.coalesce(F.nullif(F.array_position(known, F.col("declared")), F.lit(0)).cast("int") - 1, F.lit(k - 1)))
    host = F.col("host")
    labelled = rows.withColumn("declared", subtag(F.col("declared"))).withColumns({
        "declared": declared, "domain": F.when(host.contains("."), F.substring_index(host, ".", -2)), "suffix": F.when(host.contains("."), F.substring_index(host, ".", -1)),
    })
    best = F.expr("cast(array_position(likelihood, array_max(likelihood)) as int) - 1")
    seen = keep(evidence(labelled.select(*carry, "text", "is_page", "declared", "host", "domain", "suffix"), model, s).withColumn("best", F.when(F.col("letters"), best)))

    confusion = np.ones((k, k + 1))
    for r in seen.where("best is not null").groupBy("best", "declared").count().collect():  # at most k * (k + 1) rows
        confusion[r["best"], r["declared"]] += r["count"]
    confusion = np.log(confusion / confusion.sum(axis=1, keepdims=True))
    of_declared = F.array(*(F.array(*map(F.lit, map(float, confusion[:, d]))) for d in range(k + 1)))

    counts = F.expr(f"array({', '.join(f'cast(coalesce(sum(int(best = {i})), 0) as double)' for i in range(k))})")
    hosts = keep(seen.groupBy("host", "domain", "suffix").agg(counts.alias("n")))
    summed = F.expr(f"array({', '.join(f'sum(n[{i}])' for i in range(k))})").alias("n")
    domains, suffixes = hosts.groupBy("domain", "suffix").agg(summed), hosts.groupBy("suffix").agg(summed)
    total = hosts.agg(summed).first()["n"]
    total = np.array([x or 0.0 for x in total]) + 1 / k
    suffixes = suffixes.withColumn("share", F.expr(f"zip_with(n, array({', '.join(f'{x}D' for x in total / total.sum())}), (x, p) -> (x + {s.suffix} * p) / (aggregate(n, 0D, (a, y) -> a + y) + {s.suffix}))"))
    domains = _widened(domains, suffixes, "suffix", s.domain)
    priors = keep(hosts.join(domains.select(F.col("domain").alias("of"), F.col("share")), F.col("domain").eqNullSafe(F.col("of"))).select(F.col("host").alias("of_host"), "n", "share"))

    own = "(aggregate(n, 0D, (a, y) -> a + y) - if(best is null, 0, 1))"
    prior = F.expr(f"transform(n, (x, i) -> ln((x - if(best = i, 1, 0) + {s.host} * share[i]) / ({own} + {s.host})))")
    fused = (
        seen.join(priors, F.col("host").eqNullSafe(F.col("of_host")))
        .withColumn("prior", prior)
        .withColumn("fused", F.expr("zip_with(likelihood, prior, (x, y) -> x + y)"))
        .withColumn("fused", F.zip_with("fused", of_declared[F.col("declared")], lambda x, y: x + y))
        .withColumn("at", F.expr("cast(array_position(fused, array_max(fused)) as int) - 1"))
        .withColumn("posterior", F.expr("1 / aggregate(fused, 0D, (a, x) -> a + exp(x - array_max(fused)))"))
    )
    named = F.array(*map(F.lit, model.names))
    accepted = F.col("letters") & (F.col("at") < k - 1) & (F.col("posterior") >= s.sure)
    return fused.select(*carry, F.get(named, F.col("best")).alias("text_lang"), F.get(named, F.col("at")).alias("lang"), "posterior", accepted.alias("accepted"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as rows of identify(): the declared language is lang, the host is source."""
    return docs.withColumns({"text": F.col("text").cast("string"), "is_page": F.lit(False), "declared": F.col("lang").cast("string"), "host": F.col("source").cast("string")})


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages as rows of identify(): declared by the html element, the host taken from url."""
    return pages.withColumns({"text": F.col("html").cast("string"), "is_page": F.lit(True), "declared": declared_in(F.col("html")), "host": F.nullif(host_of(F.col("url")), F.lit(""))})
