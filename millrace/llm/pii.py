"""Personal data by bootstrapped contextual extraction, on DataFrame functions only.

Four base kinds are found by strict patterns and checks; they are the seeds. Looser shapes give
candidates (numbers without the plus sign, addresses written with "(at)", masked cards ...). Texts are
read as tokens: runs of letters, runs of digits (as zeros), single other signs. The one and the two
tokens before and after a seed or a candidate are lexical patterns. Patterns and instances form a
bipartite graph, scored in rounds: a pattern with at least SUPPORT distinct known instances has as
confidence the score of these against all its other occurrences in the corpus (a candidate that is not
known yet weighs UNKNOWN against it); a candidate's score is the
noisy-or of its patterns of confidence STRONG and more; candidates that reach ACCEPT are known from
then on, so that what they stand beside becomes a pattern in the next round. Rounds go on until none
is new. An instance counts wherever it occurs.

What bounds a shape is what its kind allows: 12 to 19 digits or masks of a card, 7 to 15 digits of a
phone; runs are read whole and then counted. A token that reaches beyond CONTEXT code points from its
span gives no pattern; it is never cut.

Defined cases: null text is empty; a document without findings has empty lists, whose digest is
that of the empty string; rows are told apart by a row id, so repeated or null doc_ids stay
separate, and a repeated row counts as often as it occurs; of overlapping candidates the kind listed
first stays, then the one that begins first; very long texts are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
SMOOTH = 2.0
#: How much an occurrence before an unknown candidate weighs against a pattern; one before neither weighs 1.
UNKNOWN = 0.25
ACCEPT = 0.8
STRONG = 0.5
CONTEXT = 48
#: So many tokens are looked for by a set of hashes in the plan; more of them by a join.
FEW_TOKENS = 10_000
PATTERN = ["k", "side", "token"]
TOKEN = r"[\p{L}\p{M}_]++|[0-9]++|[^\s\p{L}\p{M}0-9_]"

_LOCAL = "[A-Za-z0-9._%+-]"
#: Written without backtracking; each finds what the plain form finds.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What a text must hold before a base pattern is tried.
NEEDS = {"email": "@", "ip": None, "card": None, "phone": "+"}
_AT, _DOT = r"(?:@|\s?(?:\(at\)|\[at\]|\{at\})\s?)", r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?)"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{2,}}+{_AT}[A-Za-z0-9-]{{2,}}+(?:{_DOT}[A-Za-z0-9-]{{2,}}+)*+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:[._-][0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){4,7})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9Xx*])[0-9](?:[\x20-]?[0-9Xx*])++",
    "phone": r"(?<![0-9+])\(?[0-9](?:[\x20().-]*+[0-9])++",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _fits(kind: str, m: Column) -> Column:
    if kind == "card":
        return F.length(F.regexp_replace(m, "[^0-9Xx*]", "")).between(12, 19)
    if kind == "phone":
        return F.length(_digits(m)).between(7, 15)
    return F.lit(True)


_SPAN = "array<struct<k:int,s:int,e:int,t:string>>"


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their places: matches lie between the gaps of a split."""
    k = KINDS.index(kind)
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        one = F.struct(F.lit(k).alias("k"), start.alias("s"), end.alias("e"), x["m"].alias("t"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def base_spans(text: Column, kind: str) -> Column:
    need = F.lit(True) if NEEDS[kind] is None else F.contains(text, F.lit(NEEDS[kind]))
    found = F.filter(_spans(text, kind, BASE[kind]), lambda x: _holds(kind, x["t"]))
    return F.when(need & text.rlike(BASE[kind]), found).otherwise(F.array().cast(_SPAN))


def loose_spans(text: Column, kind: str) -> Column:
    found = F.filter(_spans(text, kind, LOOSE[kind]), lambda x: _fits(kind, x["t"]))
    return F.when(text.rlike(LOOSE[kind]), found).otherwise(F.array().cast(_SPAN))


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, digits as zeros; a space in front where white space was."""
    plain = F.translate(F.lower(text), "123456789\t\n\x0b\x0c\r", "000000000     ")
    return F.regexp_extract_all(plain, F.lit(rf" ?(?:{TOKEN})"), F.lit(0))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def grams(text: Column) -> Column:
    """Single tokens, and pairs of neighbours as they are written."""
    pairs = lambda t, n: F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(F.ltrim(a), b))
    return _once(tokens(text), lambda t: F.concat(F.transform(t, F.ltrim), pairs(t, F.greatest(F.size(t) - 1, F.lit(0)))))


def _mentions(text: Column, base: Column, loose: Column) -> Column:
    free = F.filter(loose, lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))

    def mention(seed: bool):
        def make(x: Column) -> Column:
            lo = F.greatest(x["s"] - CONTEXT, F.lit(0))
            # what touches the far edge of its window may go on beyond it
            before = lambda t: F.slice(t, F.greatest(F.size(t) - 1, F.when(lo > 0, 2).otherwise(1)), 2)
            after = lambda t: F.slice(t, 1, F.least(F.size(t) - F.when(F.length(text) > x["e"] + CONTEXT, 1).otherwise(0), F.lit(2)))
            left = _once(tokens(F.substring(text, lo + 1, x["s"] - lo)), before)
            right = _once(tokens(F.substring(text, x["e"] + 1, F.lit(CONTEXT))), lambda t: F.when(F.size(t) > 0, after(t)).otherwise(t))
            return F.struct(
                x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["t"]).alias("inst"), F.lit(seed).alias("seed"),
                left.alias("left"), right.alias("right"),
            )

        return make

    return F.concat(F.transform(base, mention(True)), F.transform(free, mention(False)))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def occurrences(texts: DataFrame, wanted: DataFrame, few: int = FEW_TOKENS) -> DataFrame:
    """(token, n_all): how often each wanted token or pair of tokens occurs in the texts."""
    words = texts.select(F.explode(grams(F.col("text"))).alias("token"))
    some = [r["h"] for r in wanted.select(F.xxhash64("token").alias("h")).limit(few + 1).collect()]
    if len(some) <= few:
        words = words.where(F.xxhash64("token").isin(some))
    counted = words.groupBy("token").agg(F.count(F.lit(1)).alias("n_all"))  # counted before they are joined
    return counted.join(wanted, "token", "left_semi")


def discover(texts: DataFrame, mentions: DataFrame, scratch: Scratch, support: int = SUPPORT) -> DataFrame:
    """(k, inst) of the candidates that high-confidence patterns introduce."""
    one = lambda c, i: F.ltrim(F.try_element_at(c, F.lit(i)))
    two = lambda c: F.when(F.size(c) == 2, F.concat(one(c, 1), c[1]))
    left, right = F.col("left"), F.col("right")
    sides = {"L": F.when(F.size(left) > 0, one(left, -1)), "LL": two(left), "R": F.when(F.size(right) > 0, one(right, 1)), "RR": two(right)}
    near = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), t.alias("token")) for s, t in sides.items()]))
    links = mentions.select("k", "inst", "seed", near.alias("p")).select("k", "inst", "seed", "p.*").where("token IS NOT NULL")
    links = scratch.save(links.groupBy(*PATTERN, "inst", "seed").agg(F.count(F.lit(1)).alias("m")), "links")
    known, n_known = links.where("false").select("k", "inst", F.lit(0.0).alias("score")), 0
    totals = links.where("false").select("token", F.lit(0).cast("long").alias("n_all"))
    counted: list[DataFrame] = []
    while True:
        now = links.join(known, ["k", "inst"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.col("score")))
        admitted = now.groupBy(*PATTERN).agg(
            F.count("score").alias("support"), F.count_if(~F.col("seed")).alias("others"), F.sum("m").alias("uses"),
            F.sum(F.coalesce(F.col("m") * F.col("score"), F.lit(0.0))).alias("mass"), F.sum(F.when(F.col("score").isNull(), F.col("m")).otherwise(0)).alias("open"),
        )
        # only patterns that introduce some candidate can discover one
        admitted = scratch.save(admitted.where((F.col("support") >= support) & (F.col("others") > 0)), "admitted")
        new = admitted.select("token").distinct().join(totals, "token", "left_anti")
        if not new.isEmpty():
            counted.append(scratch.save(occurrences(texts, scratch.save(new, "wanted")), "totals"))
            totals = reduce(DataFrame.unionByName, counted)
        against = F.greatest(F.coalesce("n_all", F.lit(0)) - F.col("uses"), F.lit(0)) + UNKNOWN * F.col("open") + SMOOTH
        strong = admitted.join(totals, "token", "left").select(*PATTERN, (F.col("mass") / (F.col("mass") + against)).alias("conf")).where(F.col("conf") >= STRONG)
        heard = links.where("NOT seed").join(strong, PATTERN).groupBy("k", "inst").agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score"))
        known = scratch.save(heard.where(F.col("score") >= ACCEPT), "known")
        n, before = known.count(), n_known
        if n == before:  # what is known stays known, so equal counts are equal sets
            return known.select("k", "inst")
        n_known = n


def find_pii(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found for every document."""
    scratch = Scratch(docs.sparkSession, "pii")
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.concat(*[base_spans(F.col("text"), k) for k in KINDS])
    # one candidate a place: kinds that come later give way
    loose = F.aggregate(
        F.concat(*[loose_spans(F.col("text"), k) for k in KINDS]), F.array().cast(_SPAN),
        lambda acc, c: F.when(F.exists(acc, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])), acc).otherwise(F.concat(acc, F.array(c))),
    )
    has = F.col("text").rlike("[0-9@]|[(\\[{]at[)\\]}]")
    scanned = texts.withColumn("base", F.when(has, base).otherwise(F.array().cast(_SPAN))).withColumn("loose", F.when(has, loose).otherwise(F.array().cast(_SPAN)))
    marks = scratch.save(scanned.select("rid", "doc_id", "base", _mentions(F.col("text"), F.col("base"), F.col("loose")).alias("mentions")), "marks")
    mentions = marks.select("rid", F.explode("mentions").alias("x")).select("rid", "x.*")
    found = discover(docs.select("text").where("text IS NOT NULL"), mentions, scratch, support)
    new = mentions.where("not seed").join(found, ["k", "inst"]).groupBy("rid").agg(F.collect_list(F.struct("k", "s", "e", F.col("inst").alias("t"))).alias("new"))
    out = marks.drop("mentions").join(new, "rid", "left").withColumn("new", F.coalesce("new", F.array().cast(_SPAN)))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "new"))).alias("spans"), F.size("new").cast("long").alias("n_found"),
    )
