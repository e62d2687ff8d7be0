"""Personal data by bootstrapped contextual extraction.

Seed entities are what the agreed rules find (e-mail and IP addresses, payment
cards, phone numbers).  Runs of one to ``RUN_WORDS`` adjacent identifier-like
words (words with a digit or an ``@``) are candidates; one that is just what a
rule found is a seed, one that touches nothing found is free.  Their lexical
patterns are the two words before them (identifiers among these by their
shape; not for free runs of several words), the word before with the
candidate's shape, and the candidate's form (letter runs, every digit).
Patterns and the distinct instances found with them form a bipartite graph,
scored in rounds:

    confidence(pattern) = (sum of its instances' scores + prior * share of seeds)
                          / (instances + prior)
    score(instance)     = 1 for seeds, else 1 - product of (1 - confidence)
                          over its patterns of at least the threshold

Free instances whose score reaches the threshold are promoted with that score
and count for the patterns of the next round; the rounds end when a round
promotes none.  Prior and threshold are fitted on the graph: a fifth of the
seeds is hidden, and the pair is taken that finds them again with the best F0.5
measure, free instances counted as errors.  Free candidates that are promoted,
or are a seed elsewhere, become spans of kind ``learned``, leftmost and longest
first.

DataFrame functions only.  One pass over the texts writes spans and mentions;
the rounds run on the distinct (pattern, instance) pairs, so copies count once
and no group is collected; a round's joins are with small written tables, which
lets adaptive execution split a pattern or a text of very many rows.

Defined cases: a null text counts as empty; texts of any length are read whole;
repeated rows get equal results; without seeds nothing is learned; an empty
table gives an empty result; all input columns are kept in ``row``, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import SPAN, match_spans, materialize, no_spans, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LEARNED = "learned"
#: Words of the longest candidate run.
RUN_WORDS = 4
#: Priors and thresholds that the fit chooses from; a seed is hidden from it if this divides its hash.
PRIORS, THRESHOLDS, HIDDEN = (1.0, 2.0, 4.0, 8.0), (0.5, 0.6, 0.7, 0.8, 0.9, 0.95), 5

# The agreed kinds.  A run of one class can only match from its
# start (or from where the last match ended) on, which keeps long runs linear.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
MENTION = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _card(hit: Column) -> Column:
    return F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit))


def base_spans(text: Column) -> Column:
    """Spans of the agreed kinds, in order.  Rules run only where a character
    that they need occurs."""
    digit = F.rlike(text, F.lit("[0-9]"))
    rules = [
        (F.contains(text, F.lit("@")), EMAIL, lambda h: F.lit(True)),
        (digit & F.contains(text, F.lit(".")), IP,
         lambda h: F.rlike(h, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))),
        (digit, CARD, _card),
        (F.contains(text, F.lit("+")), PHONE, lambda h: F.length(_digits(h)).between(9, 15)),
    ]
    found = [F.when(needed, match_spans(text, pattern, kind, i, keep)).otherwise(no_spans())
             for i, (kind, (needed, pattern, keep)) in enumerate(zip(KINDS, rules))]
    return F.array_sort(F.concat(*found))


_MENTION = "struct<start:int,end:int,word:string,left:string,joined:boolean>"


def _last_two(words: Column) -> Column:
    """The last two of words with single spaces between them."""
    return F.substring_index(words, " ", -2)


def mentions(text: Column) -> Column:
    """Identifier-like words with the two words before each, and whether only
    spaces lie between it and the mention before."""
    hits = F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))
    gaps = F.split(text, MENTION, -1)
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"), F.array().cast(f"array<{_MENTION}>").alias("out"))

    def part(m, g):
        return F.struct(m.alias("hit"), shape(m).alias("shape"), F.length(g).alias("skip"),
                        F.rlike(g, F.lit(r"^\x20+$")).alias("joined"),
                        _last_two(F.lower(F.trim(F.regexp_replace(g, r"\s+", " ")))).alias("words"))

    def step(acc, x):
        begin = acc["pos"] + x["skip"]
        end = begin + F.length(x["hit"])
        left = _last_two(F.trim(F.concat_ws(" ", acc["tail"], x["words"])))
        one = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("word"), left.alias("left"),
                       (x["joined"] & (acc["pos"] > 0)).alias("joined")).cast(_MENTION)
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(
            end.alias("pos"), _last_two(F.trim(F.concat_ws(" ", left, x["shape"]))).alias("tail"),
            F.concat(acc["out"], F.array(one)).alias("out")))

    found = F.aggregate(F.zip_with(hits, gaps, part), start, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit("[0-9@]")), found).otherwise(
        F.array().cast(f"array<{_MENTION}>"))


_BEFORE, _AFTER = r"^[^\p{L}0-9@+]+", r"[^\p{L}0-9]+$"


def instance(word: Column) -> Column:
    """The word without punctuation around it."""
    return F.regexp_replace(word, rf"{_BEFORE}|{_AFTER}", "")


def shape(word: Column) -> Column:
    """Runs of letters and of digits, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(word, r"\p{L}+", "a"), "[0-9]+", "0")


def form(word: Column) -> Column:
    """Runs of letters and single digits, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(word, r"\p{L}+", "a"), "[0-9]", "0")


def candidates(found: DataFrame) -> DataFrame:
    """(key, start, end, instance, left, n_words, seed) of the runs in every
    different text that are seeds or touch no span."""
    def cut(run):  # the run's bounds without punctuation, and the spans that it touches
        head, tail = F.element_at(run, 1), F.element_at(run, -1)
        start = head["start"] + F.length(head["word"]) - F.length(F.regexp_replace(head["word"], _BEFORE, ""))
        end = tail["end"] - F.length(tail["word"]) + F.length(F.regexp_replace(tail["word"], _AFTER, ""))
        return F.struct(start.alias("start"), end.alias("end"), head["left"].alias("left"),
                        F.size(run).alias("n_words"),
                        instance(F.array_join(F.transform(run, lambda m: m["word"]), " ")).alias("instance"))

    def touched(run):
        near = F.filter("spans", lambda s: (s["start"] < run["end"]) & (s["end"] > run["start"]))
        return F.struct(run.alias("run"), F.size(near).alias("n"), F.exists(
            near, lambda s: (s["start"] == run["start"]) & (s["end"] == run["end"])).alias("seed"))

    def runs_from(m, i):  # a run goes on as long as only spaces lie before the next word
        words = [m, *[F.get("mentions", i + k) for k in range(1, RUN_WORDS)]]
        runs, follows = [F.array(m)], F.lit(True)
        for k in range(1, RUN_WORDS):
            follows = follows & words[k]["joined"]
            runs.append(F.when(follows, F.array(*words[:k + 1])))
        return F.transform(F.array_compact(F.array(*runs)), lambda run: touched(cut(run)))

    return found.select("key", "spans", "mentions").dropDuplicates(["key"]) \
        .select("key", F.explode(F.flatten(F.transform("mentions", runs_from))).alias("c")) \
        .select("key", "c.run.*", "c.n", "c.seed") \
        .where("start < end and instance <> '' and (seed or n = 0)").drop("n")


def graph(found: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, is_seed) of all candidates.  An instance that
    is a seed anywhere is one.  Patterns stand as their digests."""
    one = F.substring_index("left", " ", -1)
    two = (F.col("seed") | (F.col("n_words") == 1)) & F.contains("left", F.lit(" "))
    pairs = found.select("instance", F.col("seed").cast("int").alias("seed"), F.explode(F.array(
        F.when(two, F.concat(F.lit("2 "), F.col("left"))),
        F.when(one != "", F.concat_ws(" ", F.lit("1"), one, shape(F.col("instance")))),
        F.concat(F.lit("f "), form(F.col("instance"))))).alias("pattern")).where("pattern is not null")
    pairs = pairs.groupBy(F.md5("pattern").alias("pattern"), "instance").agg(F.max("seed").alias("seed"))
    seeds = materialize(found.where("seed").select("instance").distinct().withColumn("is_seed", F.lit(1)))
    return pairs.join(seeds, "instance", "left").select(
        "pattern", "instance", F.coalesce("is_seed", F.lit(0)).alias("is_seed"))


def _confidence(prior: float, share: float) -> Column:
    return (F.col("good") + prior * share) / (F.col("n") + prior)


def _doubt(confidence: Column, threshold: float) -> Column:
    return F.sum(F.when(confidence >= threshold, F.log(F.greatest(1 - confidence, F.lit(1e-9)))).otherwise(0.0))


def _score(doubt: Column) -> Column:
    return F.round(1 - F.exp(doubt), 9)


def share_of_seeds(edges: DataFrame) -> float | None:
    """Seeds among the instances; none without seeds."""
    n, seeds = edges.select("instance", "is_seed").distinct().agg(F.count("*"), F.sum("is_seed")).first()
    return seeds / n if seeds else None


def fitted(edges: DataFrame, share: float) -> tuple[float, float]:
    """The prior and the threshold that find hidden seeds again best."""
    hidden = (F.col("is_seed") == 1) & (F.pmod(F.xxhash64("instance"), F.lit(HIDDEN)) == 0)
    marked = edges.withColumn("hidden", hidden)
    seen = materialize(marked.where("not hidden").groupBy("pattern").agg(
        F.sum("is_seed").alias("good"), F.count("*").alias("n")).where("good > 0"))
    grid = [(p, t) for p in PRIORS for t in THRESHOLDS]
    asked = marked.where("hidden or is_seed = 0")
    scores = asked.join(seen, "pattern").groupBy("instance", "hidden").agg(
        *[_doubt(_confidence(p, share), t).alias(f"d{i}") for i, (p, t) in enumerate(grid)])
    hits = scores.agg(*[F.count_if(F.col("hidden") & (_score(F.col(f"d{i}")) >= t)) for i, (_, t) in enumerate(grid)],
                      *[F.count_if(~F.col("hidden") & (_score(F.col(f"d{i}")) >= t)) for i, (_, t) in enumerate(grid)]).first()
    wanted = asked.where("hidden").select("instance").distinct().count()

    def merit(i):  # F0.5; of equals the more careful
        right, wrong = hits[i], hits[len(grid) + i]
        return right * 1.25 / max(1.25 * right + 0.25 * (wanted - right) + wrong, 1), grid[i][1], grid[i][0]
    best = max(range(len(grid)), key=merit)
    return grid[best]


def discovered(edges: DataFrame, prior: float, threshold: float, share: float) -> DataFrame:
    """(instance, score) of the free instances that trusted patterns vouch for."""
    counts = materialize(edges.groupBy("pattern").agg(F.sum("is_seed").alias("seeds"), F.count("*").alias("n")))
    free = materialize(edges.where("is_seed = 0").select("pattern", "instance"))
    known = materialize(free.select("instance", F.lit(0.0).alias("score")).limit(0))
    while True:
        gained = materialize(free.join(known, "instance").groupBy("pattern").agg(F.sum("score").alias("more")))
        trusted = materialize(counts.join(gained, "pattern", "left").withColumn(
            "good", F.col("seeds") + F.coalesce("more", F.lit(0.0))).select(
            "pattern", _confidence(prior, share).alias("confidence")).where(F.col("confidence") >= threshold))
        scores = free.join(trusted, "pattern").groupBy("instance").agg(
            _score(_doubt(F.col("confidence"), threshold)).alias("score")).where(F.col("score") >= threshold)
        new = materialize(scores.join(known.select("instance"), "instance", "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def learned_instances(edges: DataFrame) -> DataFrame:
    """Promoted instances and seeds."""
    share = share_of_seeds(edges)
    if share is None:
        return edges.select("instance").limit(0)
    prior, threshold = fitted(edges, share)
    return discovered(edges, prior, threshold, share).select("instance").unionByName(
        edges.where("is_seed = 1").select("instance").distinct())


def _leftmost(spans: Column) -> Column:
    """Spans in order without those that overlap one taken before; of equal
    starts the longest."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s.alias("span"))))
    start = F.struct(F.lit(0).alias("pos"), no_spans().alias("out"))
    return F.aggregate(order, start, lambda acc, x: F.when(x["start"] >= acc["pos"], F.struct(
        x["span"]["end"].alias("pos"), F.concat(acc["out"], F.array(x["span"])).alias("out"))).otherwise(acc),
        lambda acc: acc["out"])


def find_personal(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns, or those in ``keep``) and
    ``spans``, ordered by start and then by kind."""
    text = text_or_empty(text_col)
    kept = F.struct(*keep) if keep else F.struct("*")
    texts = docs.select(kept.alias("row"), F.md5(text).alias("key"), text.alias("text"))
    found = materialize(texts.select("row", "key", base_spans(F.col("text")).alias("spans"),
                                     mentions(F.col("text")).alias("mentions")))
    runs = materialize(candidates(found))
    new = materialize(learned_instances(materialize(graph(runs))))
    span = F.struct("start", F.lit(len(KINDS)).alias("ord"), "end", F.lit(LEARNED).alias("kind")).cast(SPAN)
    learned = materialize(runs.where("not seed").join(new, "instance").groupBy("key").agg(
        _leftmost(F.collect_list(span)).alias("learned")))  # of one text
    return found.select("row", "key", "spans").join(learned, "key", "left").select(
        "row", F.array_sort(F.concat("spans", F.coalesce("learned", no_spans()))).alias("spans"))
