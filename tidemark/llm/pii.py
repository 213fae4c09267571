"""Personal data: patterns propose spans, checksums confirm them, words nearby move their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# For each kind, in the order in which spans at one place are listed, the pattern, a cheap test that any
# text with a match passes, the score of a confirmed match, and the words nearby that raise or lower it.
#
# The patterns find what the plain ones in comments find, in time linear in the text and without recursion: possessive
# loops where nothing could be given back, and starts only where the leftmost match can start.
_LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')", 0.9, "mail|contact|write|send", "noreply|example"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "contains({t}, '.')", 0.6, "address|host|server|login|ip", "version|release|section"),
    # [0-9]([\x20-]?[0-9])+ of 14 digits at least; shorter ones fail
    "card": (r"[0-9](?:[\x20-]?[0-9]){13,}+", "{t} rlike '[0-9][0-9 -]{13}'", 0.8, "card|visa|credit|payment|paid", "order|sku|isbn|serial"),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')", 0.7, "call|phone|tel|fax|mobile", "score|points"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "{t} rlike '[A-Z][A-Z][0-9][0-9][ A-Z0-9]{11}'", 0.8, "iban|account|bank|transfer", "serial|part"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "{t} rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", 0.3, "social|security|ssn|tax|national", "part|order"),
    "local_phone": (r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "{t} rlike '[0-9]{3}[ .-][0-9]{4}'", 0.3, "call|phone|tel|fax|mobile", "order|part|isbn"),
}
#: Their spans always stay; those of the other kinds need THRESHOLD and no overlap with these.
BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
RAISE, LOWER, NEAR = 0.3, 0.3, 40
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _digits(of: str) -> str:
    return f"regexp_replace({of}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: whether the digits' Luhn sum is a multiple of ten."""
    each = f"transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 0, int(c), int(c) * 2 - if(int(c) > 4, 9, 0)))"
    return f"(aggregate({each}, 0, (a, x) -> a + x) % 10 = 0)"


def mod_97(account: str) -> str:
    """SQL: whether an account number, its first four characters moved to its end and letters read as 10 to 35, is
    one more than a multiple of 97."""
    plain = f"replace({account}, ' ', '')"
    moved = f"concat(substr({plain}, 5), left({plain}, 4))"
    step = "(a, c) -> if(c between '0' and '9', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"(aggregate(split({moved}, ''), 0, {step}) = 1)"


_CONFIRM = {
    "email": "true",
    "ip": rf"(x.value rlike '^{_OCTET}(?:\\.{_OCTET}){{3}}$')",
    "card": f"(length({_digits('x.value')}) between 14 and 19 and {luhn(_digits('x.value'))})",
    "phone": f"(length({_digits('x.value')}) between 10 and 15)",
    "iban": f"(length(replace(x.value, ' ', '')) between 15 and 34 and {mod_97('x.value')})",
    "national_id": "(x.value not like '000%' and x.value not like '666%' and x.value not like '9%' and x.value not like '%-00-%' and x.value not like '%-0000')",
    "local_phone": "true",
}


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def found(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` and a column `found`: array<struct<start, rank, end, kind, value, score>>, by start and then by the order of
    KINDS; offsets are in code points, the end is exclusive.

    Per kind, matches are the leftmost ones that don't overlap; one that its checksum or bounds refuse is dropped. Its score
    is the kind's, raised by a word of the kind's context within NEAR code points and lowered by one that speaks
    against it. Spans of BASE kinds stay whatever the score. Others need THRESHOLD and must not overlap a base span. A
    null text counts as empty and has no spans; repeated rows get equal results; an empty table gives an empty
    result. A column named `found` is replaced; others pass through. Built-in functions only: nothing leaves the JVM and nothing is shuffled."""
    own = [c for c in df.columns if c != "found"]
    t = "__text"
    out = df.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias(t))
    names = list(KINDS)
    for k in names:
        pattern, may, *_ = KINDS[k]
        test = may.replace("{t}", t)
        # hits, and the pieces of text between them
        out = out.withColumn(f"__hits_{k}", F.expr(f"if({test}, regexp_extract_all({t}, {_quote(pattern)}, 0), cast(array() as array<string>))"))
    out = out.withColumns({f"__between_{k}": F.expr(f"if(size(__hits_{k}) = 0, cast(array() as array<string>), split({t}, {_quote(KINDS[k][0])}, -1))") for k in names})
    empty = "cast(array() as array<struct<start: int, end: int, value: string, near: string>>)"
    places = {}
    for k in names:
        h, b = f"__hits_{k}", f"__between_{k}"
        span = f"struct(s.at + char_length({b}[i]) as start, s.at + char_length({b}[i]) + char_length({h}[i]) as end, {h}[i] as value, lower(concat(right({b}[i], {NEAR}), ' ', left({b}[i + 1], {NEAR}))) as near)"
        step = f"struct(s.at + char_length({b}[i]) + char_length({h}[i]) as at, concat(s.spans, array({span})) as spans)"
        walk = f"aggregate(sequence(0, size({h}) - 1), struct(0 as at, {empty} as spans), (s, i) -> {step}, s -> s.spans)"
        places[f"__places_{k}"] = F.expr(f"if(size({h}) = 0, {empty}, {walk})")
    out = out.withColumns(places).drop(t, *(f"__hits_{k}" for k in names), *(f"__between_{k}" for k in names))
    parts = []
    for rank, k in enumerate(names):
        _, _, base, above, below = KINDS[k]
        score = f"round(double({base}) + if(x.near rlike '\\\\b(?:{above})', {RAISE}, 0) - if(x.near rlike '\\\\b(?:{below})', {LOWER}, 0), 3)"
        span = f"struct(x.start as start, {rank} as rank, x.end as end, '{k}' as kind, x.value as value, double({score}) as score)"
        parts.append(f"transform(filter(__places_{k}, x -> {_CONFIRM[k]}), x -> {span})")
    base, more = parts[: len(BASE)], parts[len(BASE) :]
    out = out.withColumns({"__base": F.expr(f"concat({', '.join(base)})"), "__more": F.expr(f"concat({', '.join(more)})")})
    clear = f"filter(__more, m -> m.score >= {THRESHOLD} and not exists(__base, b -> b.start < m.end and m.start < b.end))"
    return out.withColumn("found", F.expr(f"array_sort(concat(__base, {clear}))")).select(*own, "found")


def joined(of: str) -> str:
    """SQL: spans as kind:start:end, joined by commas."""
    return f"array_join(transform({of}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
