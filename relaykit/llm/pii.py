"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

Candidates are the matches of the base patterns and of wider ones (numbers without country code, spelt-out mail
addresses, identity numbers). Each labeler votes for (1), against (-1) or not at all (0): pattern, check digits,
gazetteer, words before. How reliable each is, is estimated without labels from how often the votes occur together.
The resulting probabilities train a naive Bayes classifier of span features, which accepts or rejects the wider
candidates; base matches always stay. Everything is built-in expressions. Only tables bounded by the number of
vote patterns and features reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaykit.llm.common import cut, stored

# Kinds in order, and their base patterns. Possessive repeats and starts at the first character of a
# run give the same leftmost matches as the plain patterns, without backtracking over long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]) ?[A-Za-z]{2,24}+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[0-9_-]*+[A-Za-z])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
KINDS = ("email", "ip", "card", "phone", "id", "secret")
# What a text must hold to be searched at all.
HINTS = {"email": "@", "phone": "+"}
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "de", "fr", "es", "uk", "eu")
_PERSON = r"(?i)(?:mail|contact|write|tel|phone|call|fax|mobile|cell|card|visa|pay|host|address|ssn|social|identity)[a-z]*[^A-Za-z0-9]{0,6}$"
_ACCESS = r"(?i)(?:token|secret|key|password|passwd|pwd|credential|bearer|auth)[a-z]*[^A-Za-z0-9]{0,6}$"
UNRELATED = r"(?i)(?:version|isbn|issn|doi|order|invoice|page|section|chapter|figure|table|build|release|commit|sha|hash|digest|checksum|uuid)[a-z]*[^A-Za-z0-9]{0,6}$"
# What issuers put before their secrets.
ISSUED = r"^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|rk[-_]|xox[abprs]-|glpat-|AIza|ya29|eyJ)"
# Each may vote for, against, or not; none sees whether a span is a base one.
LABELERS = ("form", "check", "listed", "called", "unrelated")
# How labelers are expected to vote (-1, 0, 1) on what is no personal data and what is, and how many spans that counts for.
# Form and check are common in other numbers as well; what is said before a span tells most.
EXPECTED = {
    "form": ((0.2, 0.4, 0.4), (0.05, 0.35, 0.6)), "check": ((0.2, 0.4, 0.4), (0.05, 0.35, 0.6)), "listed": ((0.4, 0.5, 0.1), (0.05, 0.35, 0.6)),
    "called": ((0.02, 0.93, 0.05), (0.02, 0.58, 0.4)), "unrelated": ((0.5, 0.48, 0.02), (0.03, 0.95, 0.02)),
}
EXPECTED_WEIGHT = 20.0
# Spans of each class that the pooled frequency of a feature counts for.
SMOOTHING = 10.0
_CHUNK = 512


@dataclass(frozen=True)
class Model:
    """Log-odds of each feature and of a span of each kind; spans at or above ``least`` are accepted."""

    features: dict[str, float]
    start: dict[str, float]
    least: float = 0.5


def _running(lengths: Column) -> Column:
    """Sums of an integer array up to each element. In chunks, as a fold copies the array it builds."""

    def fold(values: Column) -> Column:
        empty = F.array().cast("array<int>")
        return F.aggregate(
            values, F.struct(F.lit(0).alias("sum"), empty.alias("all")),
            lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"] + x)).alias("all")),
        )["all"]

    def chunked(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int"))
        return F.transform(numbers, lambda c: fold(F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK))))

    def lifted(chunks: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), fold(F.transform(chunks, lambda c: F.element_at(c, -1))))
        pairs = F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, b: F.struct(c.alias("c"), b.alias("b")))
        return F.flatten(F.transform(pairs, lambda p: F.transform(p["c"], lambda x: x + p["b"])))

    return _once(lengths, lambda values: _once(chunked(values), lifted))


def _find(text: Column, pattern: str, hint: Column) -> Column:
    """``start, end, match, before`` of every match, in code points; ``before`` is up to 32 characters of text."""

    def steps(matched: Column) -> Column:
        return F.zip_with(
            F.slice(matched["gaps"], F.lit(1), F.size(matched["found"])), matched["found"],
            lambda g, m: F.struct((F.length(g) + F.length(m)).alias("step"), m.alias("match"), F.right(g, F.lit(32)).alias("before")),
        )

    def placed(each: Column) -> Column:
        return F.zip_with(
            _running(F.transform(each, lambda s: s["step"])), each,
            lambda e, s: F.struct((e - F.length(s["match"])).alias("start"), e.alias("end"), s["match"].alias("match"), s["before"].alias("before")),
        )

    matches = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    spans = _once(matches, lambda c: _once(steps(c), placed))
    nothing = F.array().cast("array<struct<start: int, end: int, match: string, before: string>>")
    return F.when(hint & F.rlike(text, F.lit(pattern)), spans).otherwise(nothing)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def value(place: Column) -> Column:
        digit = F.substring(digits, place, F.lit(1)).cast("int")
        double = (F.length(digits) - place) % 2 == 1
        return F.when(double, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda s, x: s + x) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    """The check that a base match must pass."""
    digits = _digits(match)
    if kind == "ip":
        octet = r"(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9]))"
        return F.rlike(match, F.lit(rf"\A{octet}\.{octet}\.{octet}\.{octet}\z"))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(F.left(digits, F.lit(19)))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _valid(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: is_valid(kind, s["match"]))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _before(kind: str, span: Column) -> tuple[Column, Column]:
    """Whether the words before a span name its kind, and whether they name something else."""
    return F.rlike(span["before"], F.lit(_ACCESS if kind == "secret" else _PERSON)), F.rlike(span["before"], F.lit(UNRELATED))


def _votes(kind: str, span: Column) -> Column:
    match, digits = span["match"], _digits(span["match"])
    vote = lambda yes, no=F.lit(False): F.when(no, -1).when(yes, 1).otherwise(0)
    fits = lambda pattern, value=match: F.rlike(value, F.lit(pattern))
    form, check, listed = F.lit(0), F.lit(0), F.lit(0)
    if kind == "email":
        form = vote(fits(r"^[A-Za-z0-9]"), fits(r"\.\.|^[.-]"))
        check = vote(F.length(match).between(6, 80), F.length(match) > 254)
        listed = vote(F.lower(F.regexp_extract(match, r"([A-Za-z]+)\z", 1)).isin(*DOMAINS))
    elif kind == "ip":
        form = vote(~fits(r"(?:^|\.)0[0-9]"), fits(r"(?:^|\.)0[0-9]"))
        listed = vote(~fits(r"^(?:0|10|127|192\.168|169\.254|2[2-5][0-9])\."), fits(r"^[0-3]\.[0-9]\.[0-9]\.[0-9]$"))
    elif kind == "card":
        form = vote(fits(r"^(?:[0-9]{4}[ -]){3}|^[0-9]{14,19}$"))
        check = vote(luhn(F.left(digits, F.lit(19))))
        listed = vote(fits(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", digits), fits("^[01789]", digits))
    elif kind == "phone":
        form = vote(fits(r"^\+|\("), fits(r"\.\.|--"))
        check = vote(F.length(digits).between(10, 13), fits(r"^(?:([0-9])\1+|1234567890)$", digits))
        listed = vote(fits(r"^(?:1?[2-9][0-9]{9}|[2-9][0-9]{9,12})$", digits), fits("^0{3}", digits))
    elif kind == "id":
        form = vote(F.lit(True))
        check = vote(F.lit(False), fits("^(?:000|666|9)|^...00|0000$", digits))
    else:
        form = vote(fits(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | (fits("[a-z]") & fits("[A-Z]")), F.length(match) > 512)
        check = vote(F.length(digits) * 4 >= F.length(match), fits("(.)\\1{7}") | fits("^[A-Za-z]+(?:[-_][A-Za-z]+)+[-_]?[0-9]+$"))
        listed = vote(fits(ISSUED))
    called, unrelated = _before(kind, span)
    return F.array(form, check, listed, vote(called), vote(F.lit(False), unrelated))


def _features(kind: str, span: Column) -> Column:
    """Values of a span for the classifier; their number is fixed: 11 lengths, 21 digit counts, 32 sets of separators, 3 contexts a kind."""
    match = span["match"]
    marks = [F.when(F.rlike(match, F.lit(p)), name).otherwise("") for p, name in ((r"[ ]", "s"), (r"\.", "."), (r"[-_]", "-"), (r"[()\[\]]", "("), (r"[@+]", "@"))]
    called, unrelated = _before(kind, span)
    parts = [
        F.concat(F.lit("length "), F.least(F.floor(F.length(match) / 4), F.lit(10))),
        F.concat(F.lit("digits "), F.least(F.length(_digits(match)), F.lit(20))),
        F.concat(F.lit("marks "), *marks),
        F.when(called, "called").when(unrelated, "unrelated").otherwise("before other"),
    ]
    return F.array(*[F.concat(F.lit(f"{kind} "), p) for p in parts])


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start and kind; a null text has none."""
    body = F.coalesce(text, F.lit(""))
    numbered = F.rlike(body, F.lit("[0-9]"))
    out = []
    for kind, pattern in BASE.items():
        hint = F.instr(body, HINTS[kind]) > 0 if kind in HINTS else numbered
        out.append(_described(kind, _valid(kind, _find(body, pattern, hint)), True))
    # Wider candidates lie outside of base matches.
    for kind, pattern in WIDER.items():
        hint = (F.instr(body, "at") > 0) if kind == "email" else numbered
        out.append(_described(kind, _find(body, pattern, hint), False))
    return _once(F.concat(*out), lambda every: _once(F.filter(every, lambda s: s["base"]), lambda bases: _apart(every, bases)))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _apart(every: Column, bases: Column) -> Column:
    """All base spans, and the others that overlap none of them, in order. Few wider ones stand beside base ones in a text."""
    free = lambda s: s["base"] | ~F.exists(bases, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.sort_array(F.filter(every, free))


def _described(kind: str, spans: Column, base: bool) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            F.lit(base).alias("base"), _votes(kind, s).alias("votes"), _features(kind, s).alias("features"),
        ),
    )


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability that a span is personal data, for each kind and vote pattern, by expectation-maximisation.

    Each labeler has a table of vote probabilities, given the truth, for each kind; so has each kind its share of
    personal data. Tables begin as ``EXPECTED``, which keeps weighing as so many spans: what labelers disagree on
    is settled by who agrees with the others, and the two classes cannot change places.
    """
    start = {(l, v, y): EXPECTED_WEIGHT * EXPECTED[name][y][v + 1] for l, name in enumerate(LABELERS) for v in (-1, 0, 1) for y in (0, 1)}
    found = {}
    for kind, votes in counts:
        odds = sum(math.log(start[l, v, 1] / start[l, v, 0]) for l, v in enumerate(votes))
        found[kind, votes] = 1 / (1 + math.exp(-odds))
    for _ in range(rounds):
        vote = {(k, *at): weight for k in {kind for kind, _ in counts} for at, weight in start.items()}
        share: dict[str, list[float]] = {}
        for (kind, votes), n in counts.items():
            p = found[kind, votes]
            sums = share.setdefault(kind, [1.0, 1.0])
            sums[0] += n * (1 - p)
            sums[1] += n * p
            for l, v in enumerate(votes):
                vote[kind, l, v, 1] += n * p
                vote[kind, l, v, 0] += n * (1 - p)
        for kind, votes in counts:
            odds = math.log(share[kind][1] / share[kind][0])
            for l, v in enumerate(votes):
                yes, no = (vote[kind, l, v, y] / sum(vote[kind, l, w, y] for w in (-1, 0, 1)) for y in (1, 0))
                odds += math.log(yes / no)
            found[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return found


def train(spans: DataFrame) -> Model:
    """A classifier from rows with a column ``spans`` (see ``candidates``); without any span it accepts none but base ones."""
    each = spans.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    # At most one row for each kind and vote pattern.
    counts = {(r["kind"], tuple(r["votes"])): r["count"] for r in each.groupBy("kind", "votes").count().collect()}
    if not counts:
        return Model({}, {})
    found = reliabilities(counts)
    key = F.concat(F.col("kind"), F.lit(" "), F.array_join(F.col("votes").cast("array<string>"), " "))
    table = F.create_map(*[F.lit(x) for (k, v), p in found.items() for x in (f"{k} {' '.join(map(str, v))}", p)])
    # The features' values are fixed by their construction, 67 a kind.
    tallied = (
        each.select("kind", F.element_at(table, key).alias("p"), F.explode("features").alias("feature"))
        .groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    )
    yes = {kind: sum(n * found[k, v] for (k, v), n in counts.items() if k == kind) for kind in KINDS}
    no = {kind: sum(n * (1 - found[k, v]) for (k, v), n in counts.items() if k == kind) for kind in KINDS}
    weight = {}
    for r in tallied:
        # A class with few spans is drawn to the frequency in both, so a rare value alone speaks for neither.
        usual = SMOOTHING * (r["yes"] + r["no"]) / (yes[r["kind"]] + no[r["kind"]])
        weight[r["feature"]] = math.log((r["yes"] + usual) / (yes[r["kind"]] + SMOOTHING)) - math.log((r["no"] + usual) / (no[r["kind"]] + SMOOTHING))
    return Model(weight, {kind: math.log((yes[kind] + 1) / (no[kind] + 1)) for kind in KINDS})


def accepted(spans: Column, model: Model) -> Column:
    """The spans that are base matches or that the classifier accepts, by start and kind."""
    if not model.features:
        return F.filter(spans, lambda s: s["base"])
    table = F.create_map(*[F.lit(x) for pair in model.features.items() for x in pair])
    least = math.log(model.least / (1 - model.least))
    bounds = F.create_map(*[F.lit(x) for kind, start in model.start.items() for x in (kind, least - start)])

    def good(s: Column) -> Column:
        weights = F.transform(s["features"], lambda f: F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        return s["base"] | (F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) >= F.element_at(bounds, s["kind"]))

    return F.filter(spans, good)


def find_spans(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), model: Model | None = None) -> DataFrame:
    """The columns ``keep`` of every row and ``spans``: ``start, end`` (code points, end exclusive), ``kind``, ``base``.

    Trains on all candidates of ``df`` unless a model is given. Null and empty texts have no spans. Repeated rows
    are searched each; an empty table gives no rows.
    """
    searched = cut(df.select(*keep, candidates(F.col(text)).alias("spans")))
    return searched.withColumn("spans", accepted(F.col("spans"), model or train(searched)))


def describe(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every accepted span of its text replaced by its kind in brackets, such as ``[EMAIL]``.

    Where spans overlap, the later one goes from the end of the earlier one. A null text stays null. Repeated rows are
    redacted each; an empty table gives an empty one. Rows and their candidates are written to the shared folder once,
    as the model learns from all candidates before the first text is changed.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    searched = stored(df.select(own, candidates(F.col(f"`{text}`")).alias("spans")))
    model = train(searched.select("spans"))
    body = F.col("row")[text]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        plain = F.substring(body, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(s["end"], state["at"]).alias("at"),
            F.concat(state["parts"], F.array(plain, F.when(s["end"] > state["at"], mark).otherwise(""))).alias("parts"),
        )

    def rest(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(body, state["at"] + 1, F.length(body)))

    def replaced(spans: Column) -> Column:
        return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(body)

    clean = _once(accepted(F.col("spans"), model), replaced)
    return searched.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])
