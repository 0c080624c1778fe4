"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame and SQL functions only. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The lengths of account numbers by country (ISO 13616), so that a word that follows is not taken in.
IBAN_LENGTHS = {
    15: ["NO"],
    16: ["BE"],
    18: ["DK", "FI", "FO", "GL", "NL", "SD", "FK"],
    19: ["MK", "SI"],
    20: ["AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"],
    21: ["CH", "HR", "LI", "LV"],
    22: ["BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"],
    23: ["AE", "GI", "IL", "IQ", "OM", "SO", "TL"],
    24: ["AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"],
    25: ["LY", "PT", "ST"],
    26: ["IS", "TR"],
    27: ["BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"],
    28: ["AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "NI", "PL", "SV"],
    29: ["BR", "EG", "PS", "QA", "UA"],
    30: ["JO", "KW", "MU"],
    31: ["MT", "SC"],
    32: ["LC"],
    33: ["RU"],
}

# The patterns. Runs are possessive and start at a run's first character (or where the last match
# ended), which finds the same matches as the plain forms without trying each start of a long run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(
        rf"(?:{'|'.join(names)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, names in sorted(IBAN_LENGTHS.items())
    ) + ")(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this character has no match.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
# Words that raise a score when they stand within REACH characters of the span.
CONTEXT = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": "address|host|server|login|adresse",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|anruf|fax",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security|tax",
}
#: Words that lower a score.
AGAINST = {"ip": "version|release|section", "ssn": "order|part|item|ticket"}
REACH, RAISE = 40, 0.2


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, place: Column) -> Column:
        digit = F.ascii(F.substring(digits, -place, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(place % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def mod97(code: Column) -> Column:
    """Whether an account number (letters and digits, no blanks) has the remainder 1 of ISO 7064."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest: Column, place: Column) -> Column:
        char = F.ascii(F.substring(turned, place, F.lit(1)))
        return F.when(char < 58, (rest * 10 + char - 48) % 97).otherwise((rest * 100 + char - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is confirmed."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = r"0*+(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^(?:0*[0-9]|{part})(?:\.(?:0*[0-9]|{part})){{3}}$".replace("0*+", "0*"))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.translate(match, " ", ""))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """The confirmed matches as structs (kind, start, end, score)."""
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(matches))
    pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
    empty = F.expr("cast(array() as array<struct<m: string, start: int, end: int>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def place(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["m"])
        one = F.struct(pair["m"].alias("m"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    placed = F.filter(F.aggregate(pairs, start, place, lambda s: s["found"]), lambda s: valid(kind, s["m"]))

    def scored(span: Column) -> Column:
        first = F.greatest(span["start"] - REACH, F.lit(0))
        near = F.lower(F.concat_ws(" ", F.substring(text, first + 1, span["start"] - first), F.substring(text, span["end"] + 1, F.lit(REACH))))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), RAISE).otherwise(0.0)
        if kind in AGAINST:
            score = score - F.when(near.rlike(rf"\b(?:{AGAINST[kind]})"), RAISE).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
            F.round(F.least(score, F.lit(1.0)), 2).alias("score"),
        )

    return F.transform(placed, scored)


def unused(name: str, columns: list[str]) -> str:
    """`name`, longer until no column (case aside, as Spark names them) begins with it."""
    known = [c.lower() for c in columns]
    while any(c.startswith(name.lower()) for c in known):
        name += "_"
    return name


SPAN = "array<struct<kind: string, start: int, end: int, score: double>>"


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """`docs` with a column `out`: the spans of personal data in the whole of each text, as structs
    (kind, start, end, score), by kind in the order of PATTERNS, then start. Matches of one kind do not
    overlap; those of different kinds may. Null text is empty and has no spans. Rows stay as they are,
    repeated ones and all columns included (a column named `out` is replaced)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    spare = unused("_matches", docs.columns)
    found = {
        f"{spare}_{kind}": F.when(
            F.contains(whole, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True),
            F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)),
        )
        for kind, pattern in PATTERNS.items()
    }
    none = F.expr(f"cast(array() as {SPAN})")
    each = [
        F.when(F.size(F.col(c)) > 0, _spans(kind, whole, F.col(c)).cast(SPAN)).otherwise(none)
        for kind, c in zip(PATTERNS, found)
    ]
    return docs.withColumns(found).withColumn(out, F.concat(*each)).drop(*found)


def span_count(spans: Column, kind: str) -> Column:
    """How many of the spans are of this kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def span_text(spans: Column, kinds: list[str]) -> Column:
    """The spans of these kinds as kind:start:end, joined with commas."""
    own = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.concat_ws(",", F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """`docs` (with text) with each span of a score of `least` or more replaced by its kind, as in [email].

    Columns may have any names. Spans that overlap are replaced together, under the name of the first. Texts without spans, and nulls,
    stay as they are; n_chars, where there is such a column, is set to the new length of changed texts.
    """
    own = unused("_redact", docs.columns)
    pii, chosen, new_text = (f"{own}_{x}" for x in ("pii", "spans", "text"))
    spans = F.array_sort(F.transform(F.filter(F.col(pii), lambda s: s["score"] >= least), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    text = F.col("text")

    def step(state: Column, span: Column) -> Column:
        later = span["start"] >= state["at"]
        gap = F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit("["), span["kind"], F.lit("]"))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(later, gap).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(chosen, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    found = find_personal_data(docs, out=pii).withColumn(chosen, spans)
    found = found.withColumn(new_text, F.when(F.size(chosen) > 0, done))
    new = {"text": F.coalesce(new_text, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length(new_text).cast(docs.schema["n_chars"].dataType), "n_chars")
    return found.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
