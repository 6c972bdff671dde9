"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Built-in functions only. The patterns are written so that they take linear time in texts of any
length (possessive runs that start where a run starts) and match what the plain patterns match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind: pattern, score, context words before it, and what they add to the score.
KINDS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", 0.9, "mail|contact|write", 0.1),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, "ip|host|server|address", 0.1),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|payment|pay", 0.1),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax", 0.1),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.7, "iban|account|bank|transfer", 0.1),
    # Too common in clean text to count alone: the context lifts them over LEAST.
    "local_phone": (r"(?<![0-9+(.-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", 0.35, "phone|tel|telephone|call|mobile|cell|fax", 0.3),
    "id_number": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.35, "ssn|social|security|tax", 0.3),
    "secret": (r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+", 0.35, "password|passwd|pwd|passphrase|secret|token|key|credential|bearer", 0.3),
    "access_key": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", 0.8, "key|access", 0.1),
}
#: The kinds whose spans stay whatever their score.
BASE = ("email", "ip", "card", "phone")
#: Other spans stay from this score on.
LEAST = 0.5
#: Code points before a span in which context words count.
NEAR = 50
#: Longest secret; digits and letters that it has at least.
SECRET, DIGITS, LETTERS = 256, 4, 2

_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(d: str) -> str:
    digit = f"cast(substring({d}, -i, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + case when i % 2 = 1 then {digit} when {digit} < 5 then 2 * {digit} else 2 * {digit} - 9 end) % 10 = 0"


def _mod97(m: str) -> str:
    """Mod-97 of an account number: its first four characters go last, A is 10 and Z 35."""
    flat = f"replace({m}, ' ', '')"
    code = "ascii(substring(x, i, 1))"
    step = f"case when {code} < 65 then (r * 10 + {code} - 48) % 97 else (r * 100 + {code} - 55) % 97 end"
    return f"aggregate(array(concat(substring({flat}, 5), substring({flat}, 1, 4))), 0, (z, x) -> aggregate(sequence(1, length(x)), 0, (r, i) -> {step})) = 1"


def _valid(kind: str, m: str) -> str:
    if kind == "ip":
        return f"{m} rlike {_quoted(_IP)}"
    if kind == "card":
        d = f"regexp_replace({m}, '[ -]', '')"
        return f"case when length({d}) between 13 and 19 then {_luhn(d)} else false end"
    if kind == "phone":
        return f"length(regexp_replace({m}, '[^0-9]', '')) between 9 and 15"
    if kind == "iban":
        return f"{m} <> ''"
    if kind == "id_number":  # no area 000, 666 or 900 on, no group 00, no serial 0000
        return f"{m} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$'"
    if kind == "secret":
        return f"length({m}) <= {SECRET} and {m} rlike '^(?:[^0-9]*+[0-9]){{{DIGITS}}}' and {m} rlike '^(?:[^A-Za-z]*+[A-Za-z]){{{LETTERS}}}'"
    return "true"


def _part(kind: str, m: str) -> str:
    """The part of a match, from its start, that is the span. An account number may run into words or
    numbers after it: the longest beginning that ends with a group and passes the checksum."""
    if kind != "iban":
        return m
    ends = f"filter(sequence(length({m}), 15, -1), l -> (l = length({m}) or substring({m}, l + 1, 1) = ' ') and {_mod97(f'substring({m}, 1, l)')})"
    return f"coalesce(get(transform({ends}, l -> substring({m}, 1, l)), 0), '')"


def _worth(kind: str) -> str:
    """A cheap test that texts without the kind fail."""
    return {"email": "instr(t, '@') > 0", "phone": "instr(t, '+') > 0", "access_key": "t rlike 'A[KS]IA'", "secret": f"t rlike '[0-9]' and t rlike '(?i){KINDS[kind][2]}'"}.get(kind, "t rlike '[0-9]'")


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


#: Matches folded at a time, so that a text with very many takes no quadratic time.
FOLD = 1024

_LENGTH = "char_length(x.part) + char_length(x.hit)"


def _pairs(kind: str) -> str:
    """SQL for a kind's matches in t, each with the text between it and the match before."""
    pairs = f"zip_with(split(t, {_quoted(KINDS[kind][0])}, -1), hits_{kind}, (part, hit) -> named_struct('part', part, 'hit', hit))"
    return f"case when size(hits_{kind}) = 0 then array() else filter({pairs}, x -> x.hit is not null) end"


def _runs(kind: str) -> str:
    return f"case when size(pairs_{kind}) = 0 then cast(array() as array<int>) else sequence(0, (size(pairs_{kind}) - 1) div {FOLD}) end"


def _run(kind: str) -> str:
    return f"slice(pairs_{kind}, cast(r * {FOLD} + 1 as int), {FOLD})"


def _lengths(kind: str) -> str:
    return f"transform({_runs(kind)}, r -> aggregate({_run(kind)}, 0, (s, x) -> s + {_LENGTH}))"


def _spans(kind: str) -> str:
    """SQL for a kind's spans: what lies before a match gives its place and context."""
    _, score, words, more = KINDS[kind]
    near = f"right(x.part, {NEAR}) rlike {_quoted(f'(?i)(?<![a-z])(?:{words})')}"
    value = f"{score}D + case when {near} then {more}D else 0D end"
    own = _part(kind, "x.hit")
    span = f"named_struct('kind', '{kind}', 'start', s.at + char_length(x.part), 'end', s.at + char_length(x.part) + char_length({own}), 'score', {value})"
    keep = _valid(kind, own) + ("" if kind in BASE else f" and {value} >= {LEAST}D")
    fold = f"(s, x) -> named_struct('at', s.at + {_LENGTH}, 'out', case when {keep} then concat(s.out, array({span})) else s.out end)"
    start = f"named_struct('at', aggregate(slice(lengths_{kind}, 1, cast(r as int)), 0, (s, x) -> s + x), 'out', cast(array() as {_SPAN}))"
    return f"flatten(transform({_runs(kind)}, r -> aggregate({_run(kind)}, {start}, {fold}).out))"


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and a column for each of KINDS: arrays of (kind, start, end, score) by start, in code points,
    the end exclusive. Spans of different kinds may overlap; those of kinds outside BASE need a score of
    LEAST, which some reach only where a context word stands before them.

    Null texts count as empty; texts of any length take linear time; repeated rows give repeated rows;
    further columns are ignored; an empty table stays empty."""
    t = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    for made, sql in (
        ("hits", lambda k: f"case when {_worth(k)} then regexp_extract_all(t, {_quoted(KINDS[k][0])}, 0) else cast(array() as array<string>) end"),
        ("pairs", _pairs),
        ("lengths", _lengths),
    ):
        t = t.select("*", *[F.expr(sql(k)).alias(f"{made}_{k}") for k in KINDS])
    return t.select("doc_id", *[F.expr(_spans(k)).alias(k) for k in KINDS])


def redact(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """docs with each span that scores `least` or more replaced by <kind>; of spans that overlap, the
    one that starts first (then the longest) is replaced. Null texts stay null."""
    from .common import fresh

    (k,) = fresh(docs, "_spans")
    found = find(docs.withColumn("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), text, "doc_id")
    every = "concat(" + ", ".join(KINDS) + ")"
    order = f"array_sort(filter({every}, x -> x.score >= {float(least)}D), (a, b) -> case when a.start < b.start or a.start = b.start and a.end > b.end then -1 when a.start = b.start and a.end = b.end then 0 else 1 end)"
    found = found.select("doc_id.*", F.expr(order).alias(k))
    t = f"`{text}`"
    step = f"(s, x) -> case when x.start < s.at then s else named_struct('at', x.end, 'out', concat(s.out, substring({t}, s.at + 1, x.start - s.at), '<', x.kind, '>')) end"
    out = f"aggregate(`{k}`, named_struct('at', 0, 'out', ''), {step}, s -> concat(s.out, substring({t}, s.at + 1)))"
    return found.withColumn(text, F.expr(f"case when {t} is null then null else {out} end")).drop(k).select(*[F.col(f"`{c}`") for c in docs.columns])
