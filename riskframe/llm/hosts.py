"""Host-level quality rules, in DataFrame expressions only.

Every document is tested by a few rules. Failures are counted by host; a host's failure rate under each rule is shrunk
towards what is usual among hosts by a beta prior whose two parameters are fitted to the hosts themselves (method of
moments), so a host with three documents is not judged by three documents. A host whose shrunk rate passes the limit of
any rule is rejected with all its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm import common as c

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document fails when ``test`` holds; a host is rejected when its shrunk failure rate is above ``limit``."""

    name: str
    test: str
    limit: float = 0.5


RULES = (
    Rule("base", "n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)


def _windows(words: Column, n: Column) -> Column:
    """Each 3-word window as (hash, place), sorted, so equal windows are neighbours."""
    return F.sort_array(F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.cast("long").alias("i"))))


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts that the rules read; one pass over the texts, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    staged = docs.select(
        F.col("doc_id"), F.col(host).alias("host"), text.alias("text"), F.split(text, "\n").alias("lines"),
        F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"))
    staged = staged.select(
        "doc_id", "host", F.size("words").alias("n"), "words", F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.filter("lines", lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("full"))
    staged = staged.select(
        "doc_id", "host", "n", "n_lines", "n_symbols", "word_chars", (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("words"), F.col("n")).alias("sorted"))
    same = lambda x, k: (F.get("sorted", k - 1)["h"] == x["h"]) | (F.get("sorted", k + 1)["h"] == x["h"])
    places = F.filter("sorted", lambda x, k: F.coalesce(same(x, k), F.lit(False)))
    staged = staged.select(
        "doc_id", "host", "n", "n_lines", "n_symbols", "word_chars", "n_dup_lines", F.sort_array(F.transform(places, lambda x: x["i"])).alias("places"))
    # Each repeated window covers three words, less where the next one starts sooner.
    covered = F.aggregate(
        F.transform("places", lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get("places", k + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return staged.select(
        "doc_id", "host", F.col("n").cast("long").alias("n_words"), "n_lines", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


@dataclass(frozen=True)
class Prior:
    alpha: float
    beta: float


def _mean_variance(rate: Column, name: str) -> list[Column]:
    return [F.avg(rate).alias(f"{name}_mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias(f"{name}_var")]


def fit_priors(hosts: DataFrame, rules: tuple[Rule, ...] = RULES) -> dict[str, Prior]:
    """Beta priors by the moments of the hosts' failure rates; one row comes to the driver.

    Without spread between hosts the prior is as heavy as 1,000 documents; with more spread than a beta law can have
    it is as light as one document.
    """
    row = hosts.select(*[x for r in rules for x in _mean_variance(F.col(r.name) / F.col("n_docs"), r.name)]).first()
    priors = {}
    for r in rules:
        mean, var = row[f"{r.name}_mean"], row[f"{r.name}_var"]
        mean = 0.5 if mean is None else min(max(mean, 1e-4), 1 - 1e-4)
        weight = 1000.0 if not var else min(max(mean * (1 - mean) / var - 1, 1.0), 1000.0)
        priors[r.name] = Prior(mean * weight, (1 - mean) * weight)
    return priors


def host_verdicts(tested: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a host: n_docs, failures by rule, shrunk rates (``<rule>_rate``), host_kept."""
    counts = [F.sum(F.expr(r.test).cast("long")).alias(r.name) for r in rules]
    hosts = c.checkpointed(tested.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *counts))
    priors = fit_priors(hosts, rules)
    rates = {f"{r.name}_rate": (F.col(r.name) + priors[r.name].alpha) / (F.col("n_docs") + priors[r.name].alpha + priors[r.name].beta) for r in rules}
    rated = hosts.withColumns(rates)
    kept = F.lit(True)
    for r in rules:
        kept = kept & (F.col(f"{r.name}_rate") <= r.limit)
    return rated.withColumn("host_kept", kept)


def judge(docs: DataFrame, host: str = "source", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The features of each document, base_failed, and kept: neither failed itself nor on a rejected host.

    A null text is an empty one and fails. A null host is no host: such documents are judged alone. Repeated rows are
    judged each and count each for their host. Further columns are not read. An empty table gives an empty result.
    """
    tested = c.checkpointed(features(docs, host))
    verdicts = host_verdicts(tested, rules).select(F.col("host").alias("_host"), "host_kept")
    joined = tested.join(verdicts, tested["host"] == verdicts["_host"], "left")
    base = F.expr(next(r.test for r in rules if r.name == "base"))
    return joined.select(
        "doc_id", "host", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & F.coalesce("host_kept", F.lit(True))).alias("kept"))


def _sql_prior(r: Rule) -> str:
    mean = f"least(greatest(avg({r.name} / n_docs::double), 0.0001), 0.9999)"
    var = f"var_pop({r.name} / n_docs::double)"
    weight = f"case when {var} = 0 then 1000.0 else least(greatest({mean} * (1 - {mean}) / {var} - 1, 1.0), 1000.0) end"
    return f"{mean} * ({weight}) as {r.name}_a, {weight} as {r.name}_w"


#: DuckDB SQL of the query over ``documents`` with ``source`` as the host.
SQL = rf"""
with d as (
  select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as text from documents
), w as (
  select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as full_lines from d
), win as (
  select rid, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
  from (select rid, words, unnest(generate_series(1, len(words) - 2)) as i from w)
), rep as (
  select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as k from win) where k >= 2
), cov as (
  select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid
), f as (
  select w.rid, doc_id, host, len(words)::bigint as n_words, len(string_split(text, chr(10)))::bigint as n_lines,
    len(array_to_string(words, ''))::bigint as word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(full_lines) - len(list_distinct(full_lines)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
  from w left join cov on w.rid = cov.rid
), h as (
  select host, count(*) as n_docs, {", ".join(f"sum(({r.test})::int) as {r.name}" for r in RULES)} from f where host is not null group by host
), p as (
  select {", ".join(_sql_prior(r) for r in RULES)} from h
), v as (
  select host, {" and ".join(f"({r.name} + {r.name}_a) / (n_docs + {r.name}_w) <= {r.limit}" for r in RULES)} as host_kept from h, p
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({RULES[0].test}) as base_failed,
  not ({RULES[0].test}) and coalesce(host_kept, true) as kept
from f left join v on f.host = v.host
"""
