"""Scalar functions on text, dates, amounts and lists: column expressions, but for the two that need Unicode folding.

Whitespace, digits and word characters are Unicode's, hence ``(?U)``; lengths are code points.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for no value, without white space and folded.
EMPTY_MARKERS = ["-", "n/a", "na", "none", "null", "unknown", "notprovided", "없음", "미기재", "해당없음", "무", "알수없음", "확인필요"]
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
# Patterns of personal data and their masks, in order.
MASKS = [
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[email]"),
    (r"(?:010|011|016|017|018|019|02|0[3-6]\d|070)[-\s]?\d{3,4}[-\s]?\d{4}", "[phone]"),
    (r"\b\d{6}[-\s]?\d{7}\b", "[personal-id]"),
    (r"\b\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}\b", "[date]"),
]
# Keys of personal fields.
SENSITIVE_KEYS = [
    "address", "birth_date", "birthDate", "contact", "dateOfBirth", "date_of_birth", "disability", "email", "exemption_reason", "gender", "military", "militaryId", "militaryRows",
    "military_end_period_raw", "military_rank", "military_service", "military_start_period_raw", "military_type", "name", "phone", "veteranEligibility", "veteran_eligibility",
]


def squeezed(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\s+", "")


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def clean(col: Column) -> Column:
    """Stripped; null if nothing is left or the text stands for no value."""
    value = strip(col)
    return F.when((value == "") | F.lower(squeezed(value)).isin(EMPTY_MARKERS), None).otherwise(value)


def limit(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def truncate(col: Column, n: int) -> Column:
    """Cut to n characters; what a cut leaves is stripped at the right."""
    return F.when(F.char_length(col) <= n, col).otherwise(F.regexp_replace(F.substring(col, 1, n), r"(?U)\s+$", ""))


def valid_email(col: Column) -> Column:
    value = clean(col)
    return F.when(value.rlike(EMAIL), value)


def money_amount(amount: Column, raw: Column) -> Column:
    """The amount, else all digits of the raw text; not above zero is null; below 100,000 with the unit 만 it is times 10,000."""
    text = clean(raw)
    found = F.coalesce(amount.cast("long"), F.regexp_replace(text, r"(?U)\D", "").try_cast("long"))
    return F.when(found > 0, F.when((found < 100000) & F.coalesce(text.contains("만"), F.lit(False)), found * 10000).otherwise(found))


def parse_date(col: Column) -> Column:
    """The first year, month and day; null if there is no such date."""
    text = F.replace(clean(col), F.lit(" "), F.lit(""))
    part = lambda i: F.regexp_extract(text, r"(\d{4})\D?(\d{1,2})\D?(\d{1,2})", i)
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd"))


@F.pandas_udf(T.StringType())
def folded(values: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark lacks."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Composed characters (NFC), which Spark lacks: names of files and what is copied from some systems have Hangul in parts."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc_cells(tables: Column) -> Column:
    """The same for tables of rows of cells, by way of their JSON text."""
    return F.from_json(nfc(F.to_json(tables)), "array<array<array<string>>>")


def normalize_position(col: Column) -> Column:
    return F.regexp_replace(folded(col), "[^0-9a-zA-Z가-힣]+", "")


SEPARATORS = r"[,/|&()\[\]\n\r]+|\s+\+\s+|\s+및\s+"


def position_terms(col: Column) -> Column:
    """The whole value and its parts, normalized, without blanks and repeats. Folding is done before splitting; it keeps the separators."""
    whole = folded(col)
    parts = F.concat(F.array(whole), F.split(whole, SEPARATORS))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "[^0-9a-zA-Z가-힣]+", "")), lambda p: p != ""))


def loose_key(col: Column) -> Column:
    """Letters, digits and Hangul only, lower case (null: empty)."""
    return F.regexp_replace(F.lower(F.coalesce(col.cast("string"), F.lit(""))), "[^a-z0-9가-힣]", "")


def without_alias(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[(（][^)）]*[)）]", "")


def identity_value(col: Column) -> Column:
    return F.regexp_replace(squeezed(F.lower(F.coalesce(col.cast("string"), F.lit("")))), "-", "")


def identity_key(name: Column, birth: Column, phone: Column, email: Column) -> Column:
    return F.concat_ws("::", identity_value(without_alias(name)), identity_value(birth), identity_value(phone), identity_value(email))


def display_name(col: Column) -> Column:
    """Without aliases in parentheses and white space."""
    return squeezed(without_alias(col))


def name_changes(col: Column) -> Column:
    return display_name(col) != strip(col)


def normalize_text(col: Column) -> Column:
    """Line ends as LF, runs of blanks as one, at most one empty line, stripped."""
    text = F.regexp_replace(F.regexp_replace(col, r"\r\n?", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


# Pieces that line breaks tear apart, by kind of source, with what joins them again.
SPLIT_EMAIL = (r"([a-zA-Z0-9._%+\-가-힣]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2})\s*\n\s*([a-zA-Z]{1,3})", "$1$2")
SPLIT_RANGE = (r"(\d{4}[.\-]\d{1,2})\s*\n\s*[-~]\s*\n\s*(\d{4}[.\-]\d{1,2})", "$1~$2")
REPAIRS = {
    "hwp": [SPLIT_EMAIL, (r"(\d{4})\s*\n\s*(\d{1,2})(?=\s*(?:\n|$))", "$1.$2"), SPLIT_RANGE],
    "pdf": [SPLIT_EMAIL, (r"((?:010|011|016|017|018|019)[-\s]?\d{3,4}[-\s]?\d{1,2})\s*\n\s*(\d{2,4})", "$1$2"), (r"(\d{4})\s+(\d{1,2})(?=\s*(?:\n|$))", "$1.$2"), SPLIT_RANGE, (r"(\d{4}[.\-]\d{1,2})\s*[-~]\s*(\d{4}[.\-]\d{1,2})", "$1~$2")],
}


def repair_broken_text(col: Column, kind: str) -> Column:
    for pattern, to in REPAIRS[kind]:
        col = F.regexp_replace(col, pattern, to)
    return col


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it (as a column of its own Spark may put it in each place)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_tight(col: Column) -> Column:
    """Lower case without white space; null is empty."""
    return F.lower(squeezed(F.coalesce(col, F.lit(""))))


def normalize_list(col: Column, fold: bool = False, max_len: int | None = None) -> Column:
    """Items stripped, blanks dropped, the first of equal ones kept; with ``fold`` equal but for case, and cut to max_len."""
    items = F.filter(F.transform(col, strip), lambda x: x != "")
    if max_len:
        items = F.transform(items, lambda x: F.substring(x, 1, max_len))
    if not fold:
        return F.array_distinct(items)
    known = lambda a, x: F.exists(a, lambda y: F.lower(y) == F.lower(x))
    return F.aggregate(items, F.array().cast("array<string>"), lambda a, x: F.when(known(a, x), a).otherwise(F.array_append(a, x)))


def mask_pii(col: Column) -> Column:
    for pattern, mask in MASKS:
        col = F.regexp_replace(col, pattern, mask)
    return col


def redact_sensitive_lines(col: Column) -> Column:
    """Lines that name a personal field go; what is left is masked and stripped."""
    lines = F.filter(F.split(col, "\r\n|\n|\r"), lambda line: ~F.lower(line).rlike("|".join(sorted({k.lower() for k in SENSITIVE_KEYS}))))
    return strip(mask_pii(F.array_join(lines, "\n")))


@F.pandas_udf(T.StringType())
def drop_sensitive_fields(values: pd.Series) -> pd.Series:
    """JSON text without the personal fields at any depth; text that isn't JSON gives null."""
    keys = set(SENSITIVE_KEYS)

    def kept(x):
        if isinstance(x, dict):
            return {k: kept(v) for k, v in x.items() if k not in keys}
        return [kept(v) for v in x] if isinstance(x, list) else x

    def one(v):
        try:
            return json.dumps(kept(json.loads(v)), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return values.map(one)


TOKENIZED = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.MapType(T.StringType(), T.StringType()))])
TOKEN_KINDS = [("EMAIL", MASKS[0][0]), ("PHONE", MASKS[1][0]), ("PID", MASKS[2][0]), ("BIRTH", MASKS[3][0])]


def tokenized(text: str, named: dict[str, str | None]) -> tuple[str, dict[str, str]]:
    """Personal values as __KIND_n__, n counting over all kinds; within a kind longer values first, then by value."""
    kinds = [(kind, sorted(set(re.findall(pattern, text)), key=lambda v: (-len(v), v))) for kind, pattern in TOKEN_KINDS]
    kinds += [(kind, [v]) for kind, v in named.items() if v and v in text]
    tokens: dict[str, str] = {}
    for kind, values in kinds:
        for value in values:
            if value in text:
                token = f"__{kind}_{len(tokens) + 1}__"
                tokens[token] = value
                text = text.replace(value, token)
    return text, tokens


@F.pandas_udf(TOKENIZED)
def tokenize_pii(text: pd.Series, name: pd.Series, address: pd.Series) -> pd.DataFrame:
    rows = [(None, {}) if t is None else tokenized(t, {"NAME": n, "ADDR": a}) for t, n, a in zip(text, name, address, strict=True)]
    return pd.DataFrame(rows, columns=["text", "tokens"])


def restore_tokens(text: Column, tokens: Column) -> Column:
    """The inverse of tokenize_pii."""
    return F.aggregate(F.map_entries(tokens), text, lambda a, e: F.replace(a, e["key"], e["value"]))


def hash_token(col: Column) -> Column:
    return F.sha2(col, 256)


def template_keys(*texts: Column) -> Column:
    """Distinct keys in order of appearance."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(r"\{([A-Za-z0-9_]+)\}"), F.lit(1)) for t in texts]))


def render_template(text: Column, values: Column) -> Column:
    """struct(text, error): {key} by its value (null: empty), doubled braces as one; a missing key or a stray brace is an error.

    The text is put together from its pieces at once, so a long value is copied once and never searched.
    """
    plain = F.replace(F.replace(text, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    key = lambda piece: F.regexp_extract(piece, r"^\{([A-Za-z0-9_]+)\}$", 1)
    braces = lambda piece: F.replace(F.replace(piece, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))

    def made(pieces: Column, values: Column) -> Column:
        keys = F.array_distinct(F.filter(F.transform(pieces, key), lambda k: k != ""))
        return once(F.array_except(keys, F.map_keys(values)), lambda missing: ended(pieces, values, missing))

    def ended(pieces: Column, values: Column, missing: Column) -> Column:
        stray = F.exists(pieces, lambda piece: (key(piece) == "") & piece.rlike(r"[{}]"))
        error = F.when(stray, F.lit("malformed")).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
        filled = F.transform(pieces, lambda piece: F.when(key(piece) != "", F.coalesce(F.try_element_at(values, key(piece)), F.lit(""))).otherwise(braces(piece)))
        return once(error, lambda e: F.struct(F.when(e.isNull(), F.array_join(filled, "")).alias("text"), e.alias("error")))

    none = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
    return F.coalesce(once(F.regexp_extract_all(plain, F.lit(r"\{[A-Za-z0-9_]+\}|[^{}]+|[{}]"), F.lit(0)), lambda pieces: F.when(pieces.isNotNull(), once(values, lambda v: made(pieces, v)))), none)


#: White space by Unicode, as the last sign of a text.
SPACES = [*"\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]


def include_link(text: Column, url: Column, label: str, names: list[str]) -> Column:
    """The URL in place of {name}; appended with its label if nothing was replaced and it isn't there. A long text without braces is searched twice only."""
    replaced = text
    for name in names:
        replaced = F.replace(replaced, F.lit("{" + name + "}"), url)
    replaced = F.when(text.contains("{"), replaced).otherwise(text)
    ends_in_space = reduce(or_, [text.endswith(c) for c in SPACES])
    bare = F.when(ends_in_space, F.regexp_replace(text, r"(?U)\s+$", "")).otherwise(text)
    return once(replaced, lambda r: F.when((r == text) & ~text.contains(url), F.concat(bare, F.lit(f"\n\n{label}: "), url)).otherwise(r))


def coerce(col: Column, known: list[str], default: str) -> Column:
    return F.when(col.isin(known), col).otherwise(F.lit(default))


EXPERIENCE = (["신입", "경력", "무관"], "무관")
APPLICATION = (["서류", "면접", "최종합격", "불합격"], "서류")
FINAL = (["진행중", "합격", "불합격"], "진행중")


def first_json_object(col: Column) -> Column:
    """The text if it is JSON, else its part from the first brace to the last, if that is; else {}."""
    valid = lambda c: F.try_parse_json(c).isNotNull()
    part = F.regexp_extract(col, r"(?s)\{.*\}", 0)
    return F.when(valid(col), col).when((part != "") & valid(part), part).otherwise("{}")
