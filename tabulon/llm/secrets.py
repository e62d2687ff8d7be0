"""Secret scan over a trigram inverted index.

Every rule's regular expression yields a Boolean query over trigrams
(:mod:`tabulon.llm.trigrams`).  The index holds one posting per trigram that
some rule asks for and text that has it, keyed by the text's digest, so copies
share their postings.  Postings are intersected by counting: a clause holds
for a text with all of its trigrams.  Only candidates of a rule are verified
with its regular expression; rules without mandatory trigrams scan every text.

Everything is DataFrame functions: one pass for the postings, one shuffle of
(digest, trigram), one join of the texts with their candidate rules (a
sort-merge join that adaptive execution splits where many copies share a
digest, or Spark's own size-checked broadcast).

Defined cases: a null text counts as empty and has no spans; texts of any
length are read whole; an empty table
gives an empty result; repeated rows each get the spans of their text; all
input columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import match_spans, materialize, no_spans, text_or_empty
from tabulon.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``min_value``: least length of group ``value`` (0: the whole match);
    shorter matches are dropped but use up their text."""

    kind: str
    pattern: str
    value: int = 0
    min_value: int = 1


# The three kinds whose results are agreed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                   r"""([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Published credential formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,200}"),
    Rule("cloud_api", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
)
RULES = BASE_RULES + MORE_RULES


def _scan_pattern(rule: Rule) -> str:
    """A run of one class with a least length matches the same when the
    length stands in the pattern; that keeps short runs out of the arrays."""
    if rule.kind == "hex" and rule.pattern == r"[0-9a-f]+":
        return rf"[0-9a-f]{{{rule.min_value},}}"
    return rule.pattern


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    def keep(hit):
        value = F.regexp_extract(hit, rule.pattern, rule.value) if rule.value else hit
        return F.length(value) >= rule.min_value
    return match_spans(text, _scan_pattern(rule), rule.kind, order, keep)


def postings(texts: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """(``key``, ``gram``): which of ``trigrams`` occur in the lower-cased text."""
    low = texts.select(key, F.lower(text).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g))
                                      for g in trigrams]))
    return low.select(key, F.explode(found).alias("gram")).distinct()


def candidates(posted: DataFrame, key: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(``key``, ``rules``): the rules of which some clause has all its trigrams.
    The terms are constants of the rules, so broadcasting them is bounded."""
    terms = [(i, j, g, len(clause)) for i, r in enumerate(rules)
             for j, clause in enumerate(trigram_query(r.pattern) or []) for g in clause]
    asked = posted.sparkSession.createDataFrame(
        terms, "rule int, clause int, gram string, need int")
    return (posted.join(F.broadcast(asked), "gram")
            .groupBy(key, "rule", "clause", "need").agg(F.count("*").alias("n"))
            .where("n = need").groupBy(key).agg(F.collect_set("rule").alias("rules")))


def find_secrets(docs: DataFrame, text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), ``text`` (null as
    empty) and ``spans``, ordered by start and then by rule."""
    text = text_or_empty(text_col)
    keyed = docs.select(F.struct("*").alias("row"), F.md5(text).alias("key"))
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for clause in q or [] for g in clause})
    if grams:
        texts = docs.select(F.md5(text).alias("key"), text.alias("text"))
        # written first, so that adaptive execution can split a text with very many copies
        found = materialize(candidates(postings(texts, "key", "text", grams), "key", rules))
        keyed = keyed.join(found, "key", "left")
    else:
        keyed = keyed.withColumn("rules", F.lit(None).cast("array<int>"))
    # the text is taken from the row only now, so it is shuffled once
    keyed = keyed.withColumn("text", F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")))
    spans = []
    for i, (rule, query) in enumerate(zip(rules, queries)):
        own = rule_spans(F.col("text"), rule, i)
        if query is not None:
            own = F.when(F.array_contains(F.coalesce("rules", F.array().cast("array<int>")), i),
                         own).otherwise(no_spans())
        spans.append(own)
    return keyed.select("row", "text", F.array_sort(F.concat(*spans)).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every maximal run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = F.struct(s["end"].alias("pos"), F.concat(
            acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]),
            F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["pos"], fresh).otherwise(longer)

    return F.aggregate(spans, start, step, lambda a: F.concat(
        a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
