"""Printed result cells as column expressions: numbers, comparators, words, titers, ranges, and the splits of a cell.

Everything here is built-in Spark SQL: the expressions stay in generated code and need no Python worker. White space
follows Unicode (``(?U)``), as Spark's own ``trim`` takes blanks only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that count as a printed qualitative result.
QUALITATIVE = (
    "negative", "positive", "none seen", "not detected", "detected", "non-reactive", "nonreactive", "reactive", "clear", "hazy", "cloudy", "turbid",
    "yellow", "pale yellow", "dark yellow", "straw", "amber", "colorless", "trace", "few", "moderate", "many", "rare", "occasional", "normal",
    "abnormal", "equivocal", "indeterminate", "pattern a", "pattern b", "a", "b", "ab", "o",
)
# Words of a qualitative result written in capitals, and those with a form of their own.
CAPITALS = ("a", "b", "ab", "o", "ana", "rbc", "wbc", "hpf", "lpf")
OWN_FORM = {"rh": "Rh", "rh(d)": "Rh(D)"}
# Spellings of the four comparators, without white space and in lower case.
COMPARATORS = {"<": "<", ">": ">", "<=": "<=", "=<": "<=", "<or=": "<=", "≤": "<=", ">=": ">=", "=>": ">=", ">or=": ">=", "≥": ">="}
# Flags.
FLAGS = ("H", "L", "HH", "LL", "A", "AA")

NUMBER = r"(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
COMPARATOR = r"(<\s*or\s*=|>\s*or\s*=|<=|>=|=<|=>|≤|≥|<|>)"
FLAG_TOKEN = r"(?i)^(?:\(?(?:H|L|HH|LL|A|AA)\)?|High|Low|Abnormal|Abn|Critical|Crit|\*+|[↑↓▲▼])$"

CELL = "struct<kind:string,value:double,comparator:string,text:string>"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Outer white space gone, every inner run one space."""
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once. Inside the functions below, which call each other for every prefix
    of a cell, an expression used in several places would otherwise be evaluated in each of them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def lookup(c: Column, pairs: dict[str, str]) -> Column:
    """The value of a fixed table, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), c)


def parse_number(c: Column) -> Column:
    t = trim(c)
    return F.when(t.rlike(f"^{NUMBER}$"), t.try_cast("double"))


def normalize_comparator(c: Column) -> Column:
    return lookup(F.lower(F.regexp_replace(c, r"(?U)\s+", "")), COMPARATORS)


def is_known_qualitative(c: Column) -> Column:
    t = F.lower(squeeze(c))
    return t.isin(*QUALITATIVE) | t.rlike(r"^[1-4]\+$")


def qualitative_case(c: Column, answers: Column | None = None) -> Column:
    """Sentence case with the words above in their own form; a listed answer wins in its own spelling."""
    t = squeeze(c)

    def form(w: Column, i: Column) -> Column:
        first = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))
        return F.when(w.isin(*CAPITALS), F.upper(w)).when(w.isin(*OWN_FORM), lookup(w, OWN_FORM)).when(i == 0, first).otherwise(w)

    cased = F.array_join(F.transform(F.split(F.lower(t), " "), form), " ")
    if answers is None:
        return cased
    return F.coalesce(F.get(F.filter(answers, lambda a: F.lower(a) == F.lower(t)), F.lit(0)), cased)


def _cell(kind: str, value=None, comparator=None, text=None) -> Column:
    fields = (F.lit(kind).alias("kind"), (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(None) if comparator is None else comparator).cast("string").alias("comparator"), (F.lit(None) if text is None else text).cast("string").alias("text"))
    return F.struct(*fields)


def parse_cell(c: Column) -> Column:
    """A titer, a number with or without comparator, or a known word, in this order; else null."""

    def of(s: Column) -> Column:
        titer = F.regexp_extract(s, r"^1\s*:\s*([0-9]+)$", 1)
        return F.when(titer != "", _cell("titer", text=F.concat(F.lit("1:"), titer.try_cast("decimal(38,0)").cast("string")))).otherwise(
            let(F.regexp_extract(s, f"(?i)^{COMPARATOR}", 1), lambda compared: other(s, compared))
        )

    def other(s: Column, compared: Column) -> Column:
        has = compared != ""
        number = parse_number(F.when(has, F.regexp_replace(s, f"(?i)^{COMPARATOR}\\s*", "")).otherwise(s))
        return let(
            number,
            lambda n: F.when(n.isNotNull(), _cell("quantity", n, F.when(has, normalize_comparator(compared)))).when(~has & is_known_qualitative(s), _cell("qualitative", text=qualitative_case(s))),
        )

    return let(squeeze(c), of)


def parse_titer(c: Column) -> Column:
    n = F.regexp_extract(trim(c), r"^(?:1\s*:\s*)?([0-9]+)$", 1).try_cast("decimal(38,0)")
    return F.when(n > 0, F.concat(F.lit("1:"), n.cast("string")))


def parse_flag(c: Column) -> Column:
    t = F.upper(trim(c))
    return F.when(t.isin(*FLAGS), t)


def parse_range(c: Column) -> Column:
    """struct<low, high, qualitative>: a closed range, a one-sided one (strictness is dropped) or a known word; else null."""
    between = f"(?i)^({NUMBER})(?: ?[-–] ?| to )({NUMBER})$"

    def made(a=None, b=None, q=None) -> Column:
        return F.struct((F.lit(None) if a is None else a).cast("double").alias("low"), (F.lit(None) if b is None else b).cast("double").alias("high"), (F.lit(None) if q is None else q).cast("string").alias("qualitative"))

    def bare(s: Column) -> Column:
        return F.when(s.startswith("(") & s.endswith(")") & (F.length(s) > 1), trim(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s)

    def one_sided(s: Column, compared: Column) -> Column:
        bound = parse_number(F.regexp_replace(s, f"(?i)^{COMPARATOR}\\s*", ""))
        upper = normalize_comparator(compared).isin("<", "<=")
        return let(bound, lambda n: F.when(n.isNotNull(), made(F.when(~upper, n), F.when(upper, n))))

    def of(s: Column) -> Column:
        low, high = (F.regexp_extract(s, between, k).try_cast("double") for k in (1, 2))
        return (
            F.when(s.rlike(between), F.when(low <= high, made(low, high)))
            .when(s.rlike(f"(?i)^{COMPARATOR}"), let(F.regexp_extract(s, f"(?i)^{COMPARATOR}", 1), lambda compared: one_sided(s, compared)))
            .when(is_known_qualitative(s), made(q=qualitative_case(s)))
        )

    return let(squeeze(c), lambda s: let(bare(s), of))


def _longest_prefix(words: Column, parse) -> Column:
    """The first of the longest prefixes that ``parse`` takes, as struct<k, found>."""
    ks = F.when(F.size(words) > 0, F.sequence(F.size(words), F.lit(1), F.lit(-1)))
    tried = F.transform(ks, lambda k: F.struct(k.alias("k"), parse(F.array_join(F.slice(words, F.lit(1), k), " ")).alias("found")))
    return F.get(F.filter(tried, lambda t: t["found"].isNotNull()), F.lit(0))


def split_value_cell(c: Column) -> Column:
    """struct<cell, value, unit, flag>: flags are taken out from the second token on, then the longest prefix that is a
    value is the value and the rest its unit."""

    def of(kept: Column, flags: Column, best: Column) -> Column:
        n = F.size(kept)
        rest = F.when(best["k"] < n, F.array_join(F.slice(kept, best["k"] + 1, n), " "))
        value = F.when(best.isNotNull(), F.array_join(F.slice(kept, F.lit(1), F.coalesce(best["k"], F.lit(1))), " ")).otherwise(F.array_join(kept, " "))
        return F.struct(best["found"].alias("cell"), value.alias("value"), rest.alias("unit"), F.when(F.size(flags) > 0, F.array_join(flags, " ")).alias("flag"))

    def parts(words: Column) -> Column:
        flags = F.filter(words, lambda t, i: (i > 0) & t.rlike(FLAG_TOKEN))
        kept = F.filter(words, lambda t, i: (i == 0) | ~t.rlike(FLAG_TOKEN))
        return let(kept, lambda k: let(flags, lambda f: let(_longest_prefix(k, parse_cell), lambda best: of(k, f, best))))

    return let(tokens(c), parts)


def split_range_cell(c: Column) -> Column:
    """struct<low, high, unit>: the longest prefix that is a range, the rest its unit; a word is no range; with no range
    at all the whole text is a unit."""

    def of(words: Column, best: Column) -> Column:
        n, word = F.size(words), best["found"]["qualitative"].isNotNull()
        rest = F.when(best.isNull() & (n > 0), F.array_join(words, " ")).when(~word & (best["k"] < n), F.array_join(F.slice(words, best["k"] + 1, n), " "))
        return F.struct(F.when(~word, best["found"]["low"]).alias("low"), F.when(~word, best["found"]["high"]).alias("high"), rest.alias("unit"))

    return let(tokens(F.regexp_replace(c, r"(?i)\bsee note:?", "")), lambda words: let(_longest_prefix(words, parse_range), lambda best: of(words, best)))
