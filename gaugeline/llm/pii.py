"""Personal data by weak supervision, in Spark expressions only.

Base spans follow the contract's four patterns. Looser patterns add candidates:
phones without a plus sign, addresses with "(at)" and "(dot)", IPv6 addresses.
Labelers vote on every candidate (1 for, -1 against, 0 silent): a regular
expression or checksum, a gazetteer (top-level domains, issuer and area
prefixes, address ranges), the words around it, and its edges. Expectation
maximisation over the counts of vote patterns - a table whose size depends only
on the number of labelers - estimates how reliable each labeler is, and its
posteriors train a logistic span classifier. Matches that fail the contract's checks
vote too, so that there is something to doubt. A loose candidate becomes a span if
the classifier says so and it overlaps no base span; base spans always stay.

The patterns are the contract's, with possessive quantifiers and look-behinds
that change no match but keep the search linear on very long runs. Null texts
count as empty; offsets are code points; repeated rows each get their result;
an empty table gives no rows and trains nothing; very long texts are read whole, and
extra columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.text import let
from gaugeline.llm import tables
from gaugeline.scratch import materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_START = rf"(?:\G|(?<!{_LOCAL}))"
BASE = {
    "email": rf"{_START}{_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"{_START}{_LOCAL}++\x20?[(\[]at[)\]]\x20?{_LABEL}++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?{_LABEL}++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without a match for this has none for the pattern; it is cheaper to search.
_HINT = {("email", 0): "@", ("email", 1): "at", ("ip", 0): ".", ("ip", 1): ":", ("card", 0): "", ("phone", 0): "+", ("phone", 1): ""}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|eu|de|fr|es|it|uk|nl|ch|at|be|pl|se|no|dk|fi|pt|ie|us|ca|au|jp|cn|in|br|ru"
CUES = {
    "email": "e-?mail|mail|contact|write|reach|courriel|correo|kontakt",
    "ip": "ip|address|host|server|client|adresse|dirección",
    "card": "card|visa|mastercard|credit|debit|payment|carte|karte|tarjeta",
    "phone": "tel|phone|call|mobile|cell|fax|téléphone|telefon|teléfono",
}
AGAINST = "version|release|isbn|order|invoice|serial|ticket|token|hash|part|model|build"
LABELERS = ("form", "gazetteer", "context", "edge")
BEFORE, AFTER = 40, 24
#: Of base matches that fail the contract's check, beside 0 for those that pass and 1 for loose candidates.
FAILED = 2


#: Stands around matches while they are found; in a text it counts as another control character, which no pattern knows.
_MARK = "\x01"
_SPANS = "array<struct<start:int,stop:int,rank:int,kind:string,loose:int,m:string,before:string,after:string>>"


def _matches(text: Column, kind: str, loose: int) -> Column:
    """array<struct<start, stop, rank, kind, loose, m, before, after>> of all matches, leftmost and not overlapping.

    One replacement puts marks around matches, and the text is cut there: what stands at odd
    places is a match. The pattern is compiled once and runs once over the text.
    """
    marked = F.regexp_replace(F.translate(text, _MARK, "\x02"), (LOOSE if loose else BASE)[kind], f"{_MARK}$0{_MARK}")
    begun = F.expr(f"struct(0 as at, false as hit, '' as before, cast(array() as {_SPANS}) as spans)")

    def step(known: Column, x: Column) -> Column:
        stop = known["at"] + F.length(x["p"])
        span = F.struct(
            known["at"].alias("start"), stop.alias("stop"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), F.lit(loose).alias("loose"),
            x["p"].alias("m"), F.right(known["before"], F.lit(BEFORE)).alias("before"), F.left(x["after"], F.lit(AFTER)).alias("after"),
        )
        return F.struct(stop.alias("at"), (~known["hit"]).alias("hit"), x["p"].alias("before"), F.when(known["hit"], F.concat(known["spans"], F.array(span))).otherwise(known["spans"]).alias("spans"))

    def found(parts: Column) -> Column:
        after = F.concat(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")))
        return F.aggregate(F.zip_with(parts, after, lambda p, a: F.struct(p.alias("p"), a.alias("after"))), begun, step)["spans"]

    hint = _HINT[kind, loose]
    likely = F.contains(text, F.lit(hint)) if hint else F.lit(True)
    if kind != "email":
        likely = likely & text.rlike("[0-9]")
    return F.when(likely, let(F.split(marked, _MARK, -1), found)).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(i, F.lit(2)) == 1, d).otherwise(twice)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b), F.lit(10)) == 0


def _passes(s: Column) -> Column:
    """The contract's check of a base match."""
    n = F.length(_digits(s["m"]))
    card = F.when((n >= 14) & (n <= 19), _luhn(_digits(s["m"]))).otherwise(F.lit(False))
    return (
        F.when(s["kind"] == "email", F.lit(True))
        .when(s["kind"] == "ip", s["m"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(s["kind"] == "card", card)
        .otherwise((n >= 10) & (n <= 15))
    )


def _checked(s: Column) -> Column:
    """A base match that fails its check gets loose = FAILED: it is no span, but labelers learn from it."""
    return s.withField("loose", F.when(_passes(s), 0).otherwise(FAILED))


def _worth_a_vote(s: Column) -> Column:
    """All that passes, and of what fails all but numbers far too short for a card."""
    return (s["loose"] == 0) | (s["kind"] != "card") | (F.length(_digits(s["m"])) >= 12)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes(s: Column) -> Column:
    """The candidate with its votes, in the order of LABELERS, and a coarse length."""
    m, kind, digits = s["m"], s["kind"], _digits(s["m"])
    form = F.when(s["loose"] != 1, 1 - s["loose"]).when(kind == "phone", _vote(m.rlike(r"^(?:\([0-9]{3}\) |[0-9]{3}([.-])[0-9]{3}\1)"), F.lit(False))).otherwise(F.lit(0))
    gazetteer = (
        F.when(kind == "email", _vote(F.lower(m).rlike(rf"(?:\.|dot[)\]]\x20?)(?:{DOMAINS})$"), ~F.lower(m).rlike(r"[a-z]$")))
        .when(kind == "ip", _vote(m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-4])\.|^[23][0-9A-Fa-f]{3}:"), m.rlike(r"^0+\.")))
        .when(kind == "card", _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^(?:0|9)")))
        .otherwise(_vote(digits.rlike("^(?:1?[2-9][0-9]{2}[2-9]|[2-9][0-9]{9,})"), digits.rlike("^0{3}")))
    )
    before = F.lower(s["before"])
    cue = F.lit(False)
    for k in KINDS:
        cue = F.when(kind == k, before.rlike(rf"(?<!\w)(?:{CUES[k]})\w?[\s:.=#]*(?:\w+[\s:.=#]+){{0,3}}$")).otherwise(cue)
    context = _vote(cue, before.rlike(rf"(?<!\w)(?:{AGAINST})\w?\s*(?:no|number|id|code)?[\s:.=#\"']*$"))
    edge = _vote(F.lit(True), s["before"].rlike(r"[\w@/\\-]$") | s["after"].rlike(r"^[\w@\\-]"))
    return F.struct(
        *[s[x].alias(x) for x in ("start", "rank", "stop", "kind", "loose")],
        F.array(form, gazetteer, context, edge).alias("votes"),
        F.when(F.length(m) > 20, 2).when(F.length(m) > 12, 1).otherwise(0).alias("long"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every base match and loose candidate of each row, with votes; texts are read once."""
    text = tables.text_of(text_col)
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    columns = {f"b_{k}": F.filter(F.transform(_matches(F.col("text"), k, 0), _checked), _worth_a_vote) for k in BASE} | {f"l_{k}": _matches(F.col("text"), k, 1) for k in LOOSE}
    wide = named.select("id", *[c.alias(n) for n, c in columns.items()])
    return wide.select("id", F.transform(F.concat(*[F.col(n) for n in columns]), _votes).alias("spans"))


def reliabilities(counts: list[tuple[tuple[int, ...], float]], rounds: int = 60, prior: float = 2.0) -> tuple[float, list]:
    """Expectation maximisation for two classes: P(true), and for each labeler P(vote | class) as [class][vote + 1].

    Starts from labelers that are right more often than not; pseudo-counts keep
    them from swapping sides where votes are few.
    """
    start = [[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]]
    share, told = 0.5, [[list(c) for c in start] for _ in LABELERS]
    for _ in range(rounds):
        sums = [[[prior * p for p in c] for c in start] for _ in LABELERS]
        mass = [1.0, 1.0]
        for votes, n in counts:
            p = posterior(votes, share, told)
            for c, w in ((0, (1 - p) * n), (1, p * n)):
                mass[c] += w
                for k, v in enumerate(votes):
                    sums[k][c][v + 1] += w
        share = mass[1] / sum(mass)
        told = [[[x / sum(c) for x in c] for c in labeler] for labeler in sums]
    return share, told


def posterior(votes: tuple[int, ...], share: float, told: list) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(told[k][1][v + 1] / told[k][0][v + 1]) for k, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def _features(kind: str, votes: tuple[int, ...], long: int) -> list[float]:
    out = [1.0] + [float(kind == k) for k in KINDS] + [float(long == n) for n in (1, 2)]
    for v in votes:
        out += [float(v == 1), float(v == -1)]
    return out


def fit(rows: list[tuple[str, tuple[int, ...], int, float]], rounds: int = 400, decay: float = 1e-3) -> list[float]:
    """Weights of the span classifier from (kind, votes, long, count), by gradient steps on the posteriors."""
    by_votes: dict = {}
    for _, votes, _, n in rows:
        by_votes[votes] = by_votes.get(votes, 0.0) + n
    share, told = reliabilities(list(by_votes.items()))
    data = [(_features(kind, votes, long), posterior(votes, share, told), n) for kind, votes, long, n in rows]
    total = sum(n for *_, n in data) or 1.0
    weights = [0.0] * len(_features(KINDS[0], (0,) * len(LABELERS), 0))
    for _ in range(rounds):
        step = [decay * w for w in weights]
        for x, p, n in data:
            off = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(weights, x)))))) - p
            for k, a in enumerate(x):
                if a:
                    step[k] += off * a * n / total
        weights = [w - 1.0 * s for w, s in zip(weights, step)]
    return weights


def _logit(s: Column, weights: list[float]) -> Column:
    w = iter(weights)
    total = F.lit(next(w))
    for k in KINDS:
        total = total + F.when(s["kind"] == k, F.lit(next(w))).otherwise(F.lit(0.0))
    for n in (1, 2):
        total = total + F.when(s["long"] == n, F.lit(next(w))).otherwise(F.lit(0.0))
    for k in range(len(LABELERS)):
        for v in (1, -1):
            total = total + F.when(s["votes"][k] == v, F.lit(next(w))).otherwise(F.lit(0.0))
    return total


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): spans in order of start, then kind as listed."""
    known = materialise(candidates(docs, id_col, text_col), "pii-candidates")
    counted = known.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.long").agg(F.count("*").alias("n"))
    weights = fit([(r["kind"], tuple(r["votes"]), r["long"], float(r["n"])) for r in counted.orderBy("kind", "votes", "long").collect()])
    base = F.array_sort(F.filter("spans", lambda s: s["loose"] == 0))
    loose = F.array_sort(F.filter("spans", lambda s: (s["loose"] == 1) & (_logit(s, weights) > 0)))
    rows = known.select("id", base.alias("base"), loose.alias("loose"))

    def keep(kept: Column, s: Column) -> Column:
        clash = F.exists(F.concat(F.col("base"), kept), lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    return rows.select("id", "base", F.aggregate("loose", F.slice("loose", 1, 0), keep).alias("added"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(tables.documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
