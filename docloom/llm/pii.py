"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose spans: the base patterns, whose valid matches are always kept, and wider ones. A
handful of labelers look at each proposal and vote for, against or not at all: what the match looks
like and whether its check digits or parts are sound (regex), what lists say about it (gazetteer),
and what stands around it (context). No proposal has a label; expectation-maximisation estimates
from the votes alone how reliable each labeler is for each kind, and so how likely each proposal is
personal data. With these soft labels a classifier over features of the span is trained, which
decides about the proposals that are not base spans.

Texts are read once. What is written in between are places, votes and feature numbers, never a
value. Proposals of the base patterns and of the wider ones of a kind are a group each, of at most
3^6 patterns of votes and 8 * 64 feature values, so an estimate is a few thousand numbers, whatever
the size of the corpus, and each round of one is an aggregate over counted proposals.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.tables import written

KINDS = ("email", "ip", "card", "phone")

# The base patterns as the contract states them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The same matches in a form that runs in proportion to the text and without recursion: a match may
# only start where a run of its characters does (or the last match ended), and repeated groups are
# possessive, which changes nothing as no other split of the match exists. Of the chains of digits
# only those of 16 to 19 digits are matched, as all others fail.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns: addresses spelled out, long addresses, shorter cards, national and 00 numbers.
_PART = "[a-z0-9-]{1,64}+"
_SPELLED = rf"\x20?(?:\(at\)|\[at\])\x20?{_PART}(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.){_PART}){{1,4}}|\x20at\x20{_PART}(?:\x20dot\x20{_PART}){{1,4}}"
_WIDE = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+(?:{_SPELLED})",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][\x20().-])(?:00[1-9][\x20.-]?[0-9]{1,4}(?:[\x20.-]?[0-9]{2,4}){2,4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![\x20.-]?[0-9])",
}
_NEEDLE = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# Code points on either side that the labelers see.
AROUND = 40

# Gazetteers. Country codes of telephone numbers, first digits of card issuers,
# addresses that belong to nobody, and ends of mail domains.
DIAL = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-6][0-9]|29[0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|6[79][0-9]|80[08]|85[0-9]|88[0-9]|9[679][0-9]"
ISSUER = "4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|6|8|5)|6(?:011|4[4-9]|5|2)"
NOBODY = r"0+|127|10|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9]|24[0-9]|25[0-5]"
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|pl|se|no|dk|fi|pt|br|mx|ar|jp|cn|in|au|ru"
# Words before a span that speak for or against each kind.
FOR = {
    "email": "e-?mails?|mails?|mailto|contact|kontakt|contacto|courriel|correo|write|reach",
    "ip": "ip|ipv[46]|host|server|address|adresse|login|client|peer",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|pan|payment",
    "phone": "tel|phone|telephone|telefon|telefono|call|mobile|cell|fax|whatsapp|ruf|appelez|llame",
}
AGAINST = "version|v|isbn|issn|order|invoice|section|chapter|page|no|nr|id|sku|serial|ref|part|token|key|hash|doi|rfc|figure|table|sum|total"

LABELERS = ("shape", "check", "list", "cue", "counter_cue", "edges")
# The check's reliability is known and not estimated: one wrong number in ten passes a check digit,
# and what fails it is none. Chances of a vote against, none, and for, if it is not, and if it is.
CHECK = ((0.45, 0.5, 0.05), (1e-6, 0.5, 0.499999))
# Of the others something is believed beforehand, worth so many proposals.
BELIEF = ((3.0, 4.0, 1.0), (1.0, 4.0, 3.0))
ROUNDS, SETTLED = 25, 1e-6
# Of the classifier: features, values of each, weight of the penalty, steps of the fit.
FEATURES, VALUES, PENALTY, STEPS = 8, 64, 0.1, 30
GROUPS = 2 * len(KINDS)
THRESHOLD = 0.95
# Matches whose places are summed together.
RUN = 128


# Expressions are SQL text from here on, as most are nested lambdas.


def _total(array: str) -> str:
    return f"aggregate({array}, 0L, (a, x) -> a + x)"


def _with_running(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add running sums ``_ends_x`` of array columns ``_sizes_x``, in runs of ``RUN``, so that time grows
    with an array's length.

    The runs' sums are columns of their own, as what stands inside a lambda is made anew each time.
    """
    run = f"slice(_sizes_{{x}}, k * {RUN} + 1, {{n}})"
    for name, made in (
        ("runs", f"if(size(_sizes_{{x}}) > 0, transform(sequence(0, (size(_sizes_{{x}}) - 1) div {RUN}), k -> {_total(run.replace('{n}', str(RUN)))}), null)"),
        ("before", f"transform(_runs_{{x}}, (r, k) -> {_total('slice(_runs_{x}, 1, k)')})"),
        ("ends", f"flatten(transform(_before_{{x}}, (b, k) -> transform({run.replace('{n}', str(RUN))}, (r, i) -> b + {_total(run.replace('{n}', 'i + 1'))})))"),
    ):
        df = df.withColumns({f"_{name}_{x}": F.expr(made.replace("{x}", x)) for x in names})
    return df


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _like(text: str, pattern: str) -> str:
    return f"{text} rlike r'{pattern}'"


def luhn(digits: str) -> str:
    """Whether a string of digits passes: every other one from the right but the last is doubled."""
    worth = "(c, i) -> if(i % 2 = 0, int(c), 2 * int(c) - if(int(c) > 4, 9, 0))"
    return f"({_total(f"transform(split(reverse({digits}), ''), {worth})")} % 10 = 0)"


def _valid(kind: str, match: str) -> str:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return _like(match, rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return f"length({_digits(match)}) between 8 and 15"
    return "true"


# Name, kind, whether a base pattern, pattern, and a cheap test that every match passes.
_PATTERNS = [(f"{kind}_base", kind, True, _BASE[kind], _NEEDLE[kind]) for kind in KINDS]
_PATTERNS += [(f"{kind}_wide", kind, False, _WIDE[kind], ":" if kind == "ip" else None) for kind in KINDS]


def _with_matches(df: DataFrame) -> DataFrame:
    """Add for each pattern the array of its matches in ``_text``, with places and surroundings.

    The text between matches and the matches themselves give the places by their lengths.
    """
    text = F.col("_text")
    none = F.array().cast("array<string>")

    def found(pattern: str, needle: str | None) -> Column:
        all_found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.when(F.contains(text, F.lit(needle)), all_found).otherwise(none) if needle else all_found

    sizes = "if(size(_found_{x}) > 0, zip_with(slice(_gaps_{x}, 1, size(_found_{x})), _found_{x}, (g, m) -> bigint(length(g) + length(m))), null)"
    names = [p[0] for p in _PATTERNS]
    df = df.withColumns({f"_found_{x}": found(pattern, needle) for x, _, _, pattern, needle in _PATTERNS})
    df = df.withColumns({f"_gaps_{x}": F.when(F.size(f"_found_{x}") > 0, F.split(text, pattern, -1)) for x, _, _, pattern, _ in _PATTERNS})
    df = _with_running(df.withColumns({f"_sizes_{x}": F.expr(sizes.replace("{x}", x)) for x in names}), names)
    return df.withColumns({x: F.expr(_span(x, kind, base)) for x, kind, base, _, _ in _PATTERNS})


def _span(x: str, kind: str, base: bool) -> str:
    fields = {
        "kind": KINDS.index(kind),
        "group": 2 * KINDS.index(kind) + (not base),
        "base": _valid(kind, "m") if base else "false",
        "start": f"get(_ends_{x}, i) - length(m)",
        "end": f"get(_ends_{x}, i)",
        "match": "m",
        "before": f"right(get(_gaps_{x}, i), {AROUND})",
        "after": f"left(get(_gaps_{x}, i + 1), {AROUND})",
    }
    return f"transform(_found_{x}, (m, i) -> named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())}))"


def _vote(good: str, bad: str) -> str:
    return f"case when {bad} then -1 when {good} then 1 else 0 end"


def _votes(kind: str, base: bool) -> str:
    """One vote of -1, 0 or 1 of each of ``LABELERS`` about the proposal ``s``."""
    match, lower, digits = "s.match", "lower(s.match)", _digits("s.match")
    valid = _valid(kind, match)
    check = _vote(valid, f"not ({valid})")
    if kind == "email":
        shape = _vote(_like(lower, r"[a-z].*(?:@|at).*[a-z]{2,}$"), _like(lower, r"(?:^|@)[.-]|\.\.|-$"))
        check = _vote(_like(lower, r"\.[a-z]{2,24}$"), _like(lower, r"\.[0-9]+$")) if base else "0"
        listed = _vote(_like(lower, rf"[. \])](?:{TOP_DOMAINS})$"), "false")
    elif kind == "ip":
        shape = _vote(_like(match, r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$") if base else "true", _like(match, r"(?:^|\.)0[0-9]"))
        check = check if base else "0"
        listed = _vote("true", _like(match, rf"^(?:{NOBODY})\.")) if base else _vote(_like(match, "^[23]"), _like(match, "^(?:[fF]|0+:)"))
    elif kind == "card":
        grouped = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$"
        shape = _vote(_like(match, grouped), _like(match, r"([0-9])\1{7}"))
        listed = _vote(_like(digits, f"^(?:{ISSUER})"), f"not ({_like(digits, '^[2-6]')})")
    else:
        grouped = r"^(?:\+|00)?[1-9]?[0-9]{0,2}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}$"
        shape = _vote(_like(match, grouped), _like(match, r"--|\.\.|\(\(|\x20\x20"))
        check = _vote("false", f"not ({valid})")
        known = _like(digits, f"^(?:00)?(?:{DIAL})") if base else _like(match, r"^(?:00|\(?[2-9])")
        listed = _vote(known, _like(digits, "^0+$"))
    cue = _vote(_like("s.before", rf"(?i)(?<!\p{{L}})(?:{FOR[kind]})(?!\p{{L}})[^\p{{L}}]*(?:\p{{L}}+[^\p{{L}}]*){{0,2}}$"), "false")
    counter = _vote("false", _like("s.before", rf"(?i)(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})[\x20.:#=\x22\x27(-]*$"))
    edges = _vote("true", f"{_like('s.before', r'[\p{L}\p{N}_]$')} or {_like('s.after', r'^[\p{L}\p{N}_]')}")
    return f"array({', '.join((shape, check, listed, cue, counter, edges))})"


def _features() -> str:
    """What the classifier sees, as ``FEATURES`` numbers below ``VALUES``: the votes, the word before
    and what separates the parts of the match, hashed."""
    word = r"lower(regexp_extract(s.before, r'(\p{L}+)[^\p{L}]*$', 1))"
    signs = r"regexp_replace(s.match, r'[\p{L}\p{N}]+', 'x')"
    return f"concat(transform(s.votes, v -> v + 1), array(pmod(hash({word}), {VALUES}), pmod(hash({signs}), {VALUES})))"


def propose(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: proposals with kind, group, whether base, place, votes and features, in order."""
    df = _with_matches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")))
    kept = ", ".join(f"'{c}', s.{c}" for c in ("kind", "group", "base", "start", "end"))
    voted = [
        F.expr(f"transform({x}, s -> named_struct({kept}, 'match', s.match, 'before', s.before, 'votes', {_votes(kind, base)}))").alias(x)
        for x, kind, base, _, _ in _PATTERNS
    ]
    # By kind, those of the base patterns first.
    names = sorted((p[0] for p in _PATTERNS), key=lambda x: (KINDS.index(x.split("_")[0]), x))
    # A proposal leaves without its text and surroundings.
    bare = f"transform(concat({', '.join(names)}), s -> named_struct({kept}, 'votes', s.votes, 'features', {_features()}))"
    return df.select("doc_id", *voted).select("doc_id", F.expr(bare).alias("spans"))


def _estimated(counted: DataFrame) -> list[tuple[float, tuple]]:
    """Expectation-maximisation over ``counted(group, votes, n)``: for each group the share of
    personal data and each labeler's chances of its votes, if it is not and if it is."""
    model: list[tuple[float, tuple]] = [(0.5, tuple(CHECK if name == "check" else _shares(BELIEF) for name in LABELERS))] * GROUPS
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("p")]
    for i in range(len(LABELERS)):
        for v in (-1, 0, 1):
            held = F.when(F.get("votes", F.lit(i)) == v, F.col("n"))
            sums += [F.sum(held).alias(f"n{i}{v}"), F.sum(held * F.col("p")).alias(f"p{i}{v}")]
    for _ in range(ROUNDS):
        found = counted.withColumn("p", _posterior(model)).groupBy("group").agg(*sums).collect()
        before, model = model, list(model)
        for r in found:
            chances = []
            for i, name in enumerate(LABELERS):
                yes = [r[f"p{i}{v}"] or 0.0 for v in (-1, 0, 1)]
                no = [(r[f"n{i}{v}"] or 0) - y for v, y in zip((-1, 0, 1), yes, strict=True)]
                seen = [[w + b for w, b in zip(row, belief, strict=True)] for row, belief in zip((no, yes), BELIEF, strict=True)]
                chances.append(CHECK if name == "check" else _shares(seen))
            # Rounded, so that the order of summing shows nowhere.
            model[r["group"]] = (round((r["p"] + 1) / (r["n"] + 2), 9), tuple(chances))
        if all(abs(a[0] - b[0]) < SETTLED for a, b in zip(model, before, strict=True)):
            break
    return model


def _shares(weights: Sequence) -> tuple:
    return tuple(tuple(round(w / sum(row), 9) for w in row) for row in weights)


def _table(values: list[float]) -> str:
    """A literal array, folded once."""
    return f"from_json('[{','.join(map(repr, values))}]', 'array<double>')"


def _sigmoid(x: str) -> str:
    return f"1 / (1 + exp(-greatest(least({x}, 500D), -500D)))"


def _posterior(model: list[tuple[float, tuple]]) -> Column:
    """How likely a proposal of ``group`` and ``votes`` is personal data."""
    start = _table([math.log(p / (1 - p)) for p, _ in model])
    gains = _table([math.log(yes[v] / no[v]) for _, chances in model for no, yes in chances for v in range(3)])
    each = f"transform(votes, (v, i) -> get({gains}, group * {3 * len(LABELERS)} + i * 3 + v + 1))"
    return F.expr(_sigmoid(f"aggregate({each}, get({start}, group), (a, x) -> a + x)"))


# The number of a feature's weight; those of the groups come after them.
_CELL = f"group * {FEATURES * VALUES} + f * {VALUES} + v"
_LAST = f"{GROUPS * FEATURES * VALUES} + group"


def _chance(weights: list[float]) -> Callable[[str], str]:
    """The classifier, logistic in the weights of a proposal's features and of its group."""
    table = _table(weights)

    def chance(s: str) -> str:
        cell, last = _CELL.replace("group", f"{s}group"), _LAST.replace("group", f"{s}group")
        each = f"transform({s}features, (v, f) -> get({table}, {cell}))"
        return _sigmoid(f"aggregate({each}, get({table}, {last}), (a, x) -> a + x)")

    return chance


def _fitted(soft: DataFrame) -> list[float]:
    """Weights of the logistic classifier for ``soft(group, features, n, p)``, ``p`` of ``n`` being personal data.

    Each step moves every weight by its gradient over its curvature, divided by the number of
    weights that a proposal has, with which the loss never rises. At most ``GROUPS * (FEATURES *
    VALUES + 1)`` sums come back a step.
    """
    weights = [0.0] * (GROUPS * (FEATURES * VALUES + 1))
    cells = f"concat(transform(features, (v, f) -> {_CELL}), array({_LAST})) as cells"
    for _ in range(STEPS):
        at = soft.selectExpr(cells, "n", "p", f"{_chance(weights)('')} as q")
        sums = at.selectExpr("explode(cells) as cell", "p - n * q as g", "n * q * (1 - q) as h").groupBy("cell")
        for r in sums.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            w = weights[r["cell"]]
            weights[r["cell"]] = round(w + (r["g"] - PENALTY * w) / (r["h"] + PENALTY) / (FEATURES + 1), 9)
    return weights


def train(proposed: DataFrame) -> Callable[[str], str]:
    """From ``propose``'s rows the classifier, as a function of a proposal's prefix: the expression
    of its chance of being personal data. No proposals give one that says 0.5."""
    spans = proposed.select(F.explode("spans").alias("s"))
    counted = written(spans.groupBy("s.group", "s.votes", "s.features").agg(F.count("*").alias("n")), "votes")
    model = _estimated(written(counted.groupBy("group", "votes").agg(F.sum("n").alias("n")), "votes").coalesce(1))
    soft = counted.groupBy("group", "features").agg(F.sum("n").alias("n"), F.sum(F.col("n") * _posterior(model)).alias("p"))
    return _chance(_fitted(written(soft, "votes")))


def find_private(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, base, added`` for ``docs(doc_id, text)``: arrays of ``kind, start, end`` in code points,
    end exclusive, by kind and start; ``added`` with the ``chance`` of each.

    ``base`` has the valid matches of the base patterns. ``added`` has the other proposals whose
    chance is ``threshold`` or more, unless they meet a base span or an added one of an earlier
    kind.

    One row per row. A null, empty or clean text has no spans, nor has an empty table rows. Null
    and repeated ``doc_id`` are passed through; equal texts have equal spans; other columns are not
    read. Spans are found in time that grows with the text.
    """
    proposed = written(propose(docs), "proposals")
    chance = train(proposed)
    named = f"'kind', element_at(array({', '.join(map(repr, KINDS))}), s.kind + 1), 'start', s.start, 'end', s.end"
    meets = "(s.start < b.end and b.start < s.end)"
    rows = proposed.selectExpr(
        "doc_id",
        "filter(spans, s -> s.base) as _base",
        f"transform(filter(spans, s -> not s.base), s -> struct(s.kind, s.start, s.end, {chance('s.')} as chance)) as _other",
    )
    for name, kept in (
        ("_likely", f"filter(_other, s -> s.chance >= {threshold})"),
        ("_clear", f"if(size(_likely) > 0, filter(_likely, s -> not exists(_base, b -> {meets})), _likely)"),
        ("_first", f"if(size(_clear) > 0, filter(_clear, s -> not exists(_clear, b -> b.kind < s.kind and {meets})), _clear)"),
    ):
        rows = rows.withColumn(name, F.expr(kept))
    return rows.selectExpr(
        "doc_id",
        f"transform(_base, s -> named_struct({named})) as base",
        f"transform(_first, s -> named_struct({named}, 'chance', s.chance)) as added",
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of what ``find_private`` returns."""
    kinds = f"array({', '.join(map(repr, KINDS))})"
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    both = f"array_sort(transform(concat(base, transform(added, s -> struct(s.kind, s.start, s.end))), s -> struct(array_position({kinds}, s.kind) as at, s.start, s.end, s.kind)))"
    return found.selectExpr(
        "doc_id",
        *(f"bigint(size(filter(base, s -> s.kind = '{kind}'))) as n_{kind}" for kind in KINDS),
        f"sha2(binary({joined.format('base')}), 256) as base_sha256",
        f"{joined.format(both)} as spans",
    )
