"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.fixtures import Tables
from staffloom.functions import text as x
from staffloom.plans.catalog import query

MARKERS = ", ".join(f"'{m}'" for m in x.EMPTY_MARKERS)


def cleaned(c: str) -> str:
    s = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return rf"CASE WHEN {s} = '' OR lower(regexp_replace({s}, '\s+', '', 'g')) IN ({MARKERS}) THEN NULL ELSE {s} END"


def masked(c: str) -> str:
    for pattern, mask in x.MASKS:
        c = f"regexp_replace({c}, '{pattern}', '{mask}', 'g')"
    return c


@query("b1_clean", f"SELECT doc_id, provider_no, {cleaned('value')} AS value FROM provider_fields")
def _(t: Tables) -> DataFrame:
    return t.provider_fields.select("doc_id", "provider_no", x.clean(F.col("value")).alias("value"))


@query("b2_truncate", r"SELECT doc_id, substr(text, 1, 100) AS cut, CASE WHEN length(text) <= 12000 THEN text ELSE regexp_replace(substr(text, 1, 12000), '\s+$', '') END AS truncated FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", x.limit(F.col("text"), 100).alias("cut"), x.truncate(F.col("text"), 12000).alias("truncated"))


@query("b3_valid_email", rf"SELECT candidate_id, CASE WHEN regexp_matches({cleaned('email')}, '{x.EMAIL}') THEN {cleaned('email')} END AS email FROM candidates")
def _(t: Tables) -> DataFrame:
    return t.candidates.select("candidate_id", x.valid_email(F.col("email")).alias("email"))


@query("b4_money_amount", """WITH raw AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS BIGINT) - 5 END AS amount, CAST(o_orderkey * 7 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN ' 만원' ELSE ' won' END AS raw FROM orders),
 f AS (SELECT *, coalesce(amount, CAST(regexp_replace(raw, '[^0-9]', '', 'g') AS BIGINT)) AS a FROM raw)
 SELECT o_orderkey, CASE WHEN a > 0 THEN CASE WHEN a < 100000 AND contains(raw, '만') THEN a * 10000 ELSE a END END AS amount FROM f""")
def _(t: Tables) -> DataFrame:
    raw = t.raw("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey - 5 END AS amount", "concat(o_orderkey * 7, CASE WHEN o_orderkey % 2 = 0 THEN ' 만원' ELSE ' won' END) AS raw")
    return raw.select("o_orderkey", x.money_amount(F.col("amount"), F.col("raw")).alias("amount"))


@query("b5_parse_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""")
def _(t: Tables) -> DataFrame:
    raw = t.raw("orders").selectExpr("o_orderkey", "CASE o_orderkey % 10 WHEN 9 THEN date_format(o_orderdate, 'yyyy.13.dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy / M / d') WHEN 2 THEN date_format(o_orderdate, 'yyyyMMdd') ELSE date_format(o_orderdate, \"yyyy'년'MM'월'dd'일'\") END AS raw")
    return raw.select("o_orderkey", F.date_format(x.parse_date(F.col("raw")), "yyyy-MM-dd").alias("parsed"))


@query("b6_normalize_position", "SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z가-힣]+', '', 'g') AS norm FROM part")
def _(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", x.normalize_position(F.col("p_name")).alias("norm"))


LOOSE = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9가-힣]', '', 'g')"
IDENT = r"regexp_replace(regexp_replace(lower(coalesce({}, '')), '\s+', '', 'g'), '-', '', 'g')"
ALIAS = r"regexp_replace(coalesce(name, ''), '[(（][^)）]*[)）]', '', 'g')"


@query("b7_identity_keys", f"SELECT candidate_id, {LOOSE.format('name')} AS loose_name, {IDENT.format(ALIAS)} || '::' || {IDENT.format('CAST(CAST(date_of_birth AS DATE) AS VARCHAR)')} || '::' || {IDENT.format('phone')} || '::' || {IDENT.format('email')} AS identity FROM candidates")
def _(t: Tables) -> DataFrame:
    c = F.col
    return t.candidates.select("candidate_id", x.loose_key(c("name")).alias("loose_name"), x.identity_key(c("name"), c("date_of_birth"), c("phone"), c("email")).alias("identity"))


@query("b8_display_name", rf"SELECT candidate_id, regexp_replace({ALIAS}, '\s+', '', 'g') AS display, regexp_replace({ALIAS}, '\s+', '', 'g') <> trim(name) AS changed FROM candidates")
def _(t: Tables) -> DataFrame:
    return t.candidates.select("candidate_id", x.display_name(F.col("name")).alias("display"), x.name_changes(F.col("name")).alias("changed"))


@query("b9_normalize_text", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", x.normalize_text(F.col("text")).alias("text"))


@query("b11_normalize_list", r"""WITH i AS (SELECT doc_id, i, substr(regexp_replace(w, '^\s+|\s+$', '', 'g'), 1, 12) AS w FROM (SELECT doc_id, unnest(string_split(text, '.')) AS w, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents)), d AS (SELECT doc_id, w, i, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) AS n FROM i WHERE w <> '')
 SELECT doc_id, coalesce((SELECT sha256(string_agg(w, '|' ORDER BY i)) FROM d WHERE d.doc_id = documents.doc_id AND n = 1), sha256('')) AS items FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.sha2(F.array_join(x.normalize_list(F.split("text", "[.]"), fold=True, max_len=12), "|"), 256).alias("items"))


@query("b12_mask_pii", f"SELECT doc_id, {masked('text')} AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", x.mask_pii(F.col("text")).alias("text"))


@query("b13_tokenize_pii")
def _(t: Tables) -> DataFrame:
    found = t.raw("documents").select("doc_id", "text", x.tokenize_pii(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("p"))
    return found.select("doc_id", F.col("p.text").alias("tokenized"), F.size("p.tokens").alias("n_tokens"), (x.restore_tokens(F.col("p.text"), F.col("p.tokens")) == F.col("text")).alias("restored"))


KEYS = "|".join(sorted({k.lower() for k in x.SENSITIVE_KEYS}))


@query("b14_redact_sensitive_lines", rf"SELECT doc_id, regexp_replace({masked(f"array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(lower(l), '{KEYS}')), chr(10))")}, '^\s+|\s+$', '', 'g') AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", x.redact_sensitive_lines(F.col("text")).alias("text"))


@query("b19_hash_token", "SELECT invite_id, sha256(raw_token) AS hashed FROM interviewer_invites")
def _(t: Tables) -> DataFrame:
    return t.interviewer_invites.select("invite_id", x.hash_token(F.col("raw_token")).alias("hashed"))


@query("b21_template_keys", r"SELECT id, array_to_string(list_distinct_ordered, ',') AS keys FROM (SELECT id, list_filter(regexp_extract_all(subject || ' ' || body, '\{([A-Za-z0-9_]+)\}', 1), lambda k, i: list_position(regexp_extract_all(subject || ' ' || body, '\{([A-Za-z0-9_]+)\}', 1), k) = i) AS list_distinct_ordered FROM written_templates)")
def _(t: Tables) -> DataFrame:
    return t.written_templates.select("id", F.array_join(x.template_keys(F.col("subject"), F.col("body")), ",").alias("keys"))


@query("b15_drop_sensitive_fields", """SELECT event_id, '{"kind": "' || event_type || '", "careers": [{"company": "C' || user_id || '"}]}' AS kept FROM events""")
def _(t: Tables) -> DataFrame:
    inner = F.array(F.struct(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("company"), F.lit("a@b.c").alias("email")))
    raw = F.to_json(F.struct(F.col("event_type").alias("kind"), F.lit("Kim").alias("name"), inner.alias("careers"), F.struct(F.lit(1).alias("x")).alias("address")))
    return t.raw("events").select("event_id", x.drop_sensitive_fields(raw).alias("kept"))


@query("b23_coerce_enum", "SELECT candidate_id, CASE WHEN level IN ('신입', '경력', '무관') THEN level ELSE '무관' END AS experience, CASE WHEN final_status IN ('진행중', '합격', '불합격') THEN final_status ELSE '진행중' END AS final_status, CASE WHEN application_status IN ('서류', '면접', '최종합격', '불합격') THEN application_status ELSE '서류' END AS application_status FROM (SELECT *, CASE WHEN candidate_id % 5 = 0 THEN 'x' ELSE experience_level END AS level FROM candidates)")
def _(t: Tables) -> DataFrame:
    level = F.when(F.col("candidate_id") % 5 == 0, "x").otherwise(F.col("experience_level"))
    return t.candidates.select("candidate_id", x.coerce(level, *x.EXPERIENCE).alias("experience"), x.coerce(F.col("final_status"), *x.FINAL).alias("final_status"), x.coerce(F.col("application_status"), *x.APPLICATION).alias("application_status"))


@query("a6_first_json_object", "SELECT event_id, CASE WHEN json_valid(props) THEN props ELSE '{}' END AS json FROM events")
def _(t: Tables) -> DataFrame:
    noisy = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))).otherwise(F.col("props"))
    return t.raw("events").select("event_id", x.first_json_object(noisy).alias("json"))
