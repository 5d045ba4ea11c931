"""Matching of resumes to positions, position categories, job descriptions.

Terms of resumes and names of positions meet by equal texts, by the rarest piece of four letters of the one that is to lie within the other, and by groups of
synonyms: equi-joins, so neither side is bounded. Titles of job sections meet names in the same way, short ones by all runs of their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffloom.functions import text as x

# Terms too broad to match by, and groups of synonyms.
BROAD = ["developer", "engineer", "개발", "개발자", "엔지니어", "직무", "지원"]
SYNONYMS = [
    ["backend", "backenddeveloper", "backendengineer", "backended", "server", "serverdeveloper", "백엔드", "백앤드", "서버"],
    ["frontend", "frontenddeveloper", "frontendengineer", "front", "react", "vue", "프론트엔드", "프론트", "웹프론트"],
    ["fullstack", "fullstackdeveloper", "풀스택", "풀스텍"],
    ["data", "dataengineer", "dataanalyst", "analytics", "데이터", "데이터분석", "데이터엔지니어"],
    ["ai", "ml", "machinelearning", "deeplearning", "llm", "인공지능", "머신러닝", "딥러닝"],
    ["devops", "sre", "infra", "infrastructure", "cloud", "데브옵스", "인프라", "클라우드"],
    ["mobile", "android", "ios", "flutter", "reactnative", "모바일", "안드로이드"],
    ["qa", "test", "tester", "qualityassurance", "품질", "테스트", "qa엔지니어"],
    ["designer", "design", "ui", "ux", "productdesigner", "디자인", "디자이너", "uiux"],
    ["pm", "po", "productmanager", "planner", "planning", "기획", "서비스기획", "프로덕트"],
]
# Keywords of position categories, in display order.
CATEGORIES = {
    "development": ["개발", "developer", "dev", "백엔드", "backend", "프론트", "frontend", "front-end", "풀스택", "fullstack", "full-stack", "임베디드", "embedded", "s/w", "sw", "소프트웨어", "software", "프로그래", "program", "시스템개발", "웹개발", "앱개발", "ios", "android", "react", "node", "java", "python", "인프라", "infra", "devops", "클라우드", "cloud", "네트워크", "network", "보안", "security", "it", "정보", "테크", "tech", "r&d", "연구개발"],
    "data": ["데이터", "data", "ai", "ml", "머신러닝", "machinelearning", "딥러닝", "deeplearning", "nlp", "llm", "분석", "analyst", "analytics", "bi", "scientist"],
    "design": ["디자인", "design", "ux", "ui", "그래픽", "graphic", "영상", "모션", "편집", "아트", "art", "크리에이티브", "creative"],
    "product": ["기획", "planner", "planning", "pm", "product", "프로덕트", "서비스기획", "사업기획", "전략기획"],
    "marketing": ["마케팅", "marketing", "홍보", "pr", "브랜드", "brand", "콘텐츠", "content", "퍼포먼스", "performance", "그로스", "growth", "커뮤니케이션"],
    "sales": ["영업", "sales", "사업", "business", "bd", "account", "해외영업", "국내영업", "무역", "trade"],
    "hr": ["인사", "hr", "humanresource", "채용", "recruit", "talent", "조직", "organization", "노무", "labor"],
    "finance": ["재무", "finance", "회계", "accounting", "accountant", "세무", "tax", "경리", "자금"],
    "manufacturing": ["생산", "제조", "manufacturing", "공정", "품질", "quality", "qc", "qa", "설비", "기계", "mechanical", "전기", "electrical", "전자", "hardware", "하드웨어", "물류", "logistics", "구매", "procurement", "자재"],
    "operations": ["경영", "운영", "operation", "ops", "총무", "admin", "법무", "legal", "compliance", "cs", "고객", "상담", "support", "서비스", "service", "md", "유통", "retail", "매장", "store"],
}


def category_name(col: Column) -> Column:
    plain = F.regexp_replace(x.squeezed(F.lower(col)), r"[·・/\\_|,.-]", "")
    return F.replace(plain, F.lit("&"), F.lit("and"))


def classify_category(col: Column) -> Column:
    """The category with the most characters of matching keywords; of equal ones the first; ``other`` if none matches."""
    import re

    plain = lambda k: re.sub(r"[·・/\\_|,.-]", "", k).replace("&", "and")
    name = category_name(col)
    scores = [F.struct(sum((F.when(name.contains(plain(k)), len(plain(k))).otherwise(0) for k in words), F.lit(0)).alias("s"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, words) in enumerate(CATEGORIES.items())]
    best = F.greatest(*scores)
    return F.when(best["s"] > 0, best["c"]).otherwise("other")


def category_groups(positions: DataFrame) -> DataFrame:
    """Positions per category in display order, ``other`` last, by name within."""
    order = F.lit([*CATEGORIES, "other"])
    rows = positions.withColumn("category", classify_category(F.col("position_name")))
    grouped = rows.groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("position_name", "position_id"))), lambda p: p["position_id"]).alias("position_ids"))
    return grouped.withColumn("place", F.array_position(order, F.col("category")).cast("int")).orderBy("place")


#: Why a term and a name match, in order of preference among equal scores.
KINDS = ["exact", "contains", "contained", "synonym"]
PIECE = 4
SHOWN = 5


def pieces(col: Column) -> Column:
    """The distinct runs of four letters of a text; none of a shorter one."""
    return F.when(F.char_length(col) >= PIECE, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(col) - PIECE + 1), lambda i: F.substring(col, i, PIECE))))


def contained_in(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """Pairs (part, whole) of distinct texts where a part of four letters or more lies within a whole.

    All pieces of a part must be pieces of the wholes; the one that the fewest wholes have leads to those.
    """
    held = wholes.select("whole", F.explode(pieces(F.col("whole"))).alias("piece"))
    times = held.groupBy("piece").agg(F.count("*").alias("n"))
    own = parts.select("part", F.size(pieces(F.col("part"))).alias("size"), F.explode(pieces(F.col("part"))).alias("piece")).join(times, "piece")
    rarest = own.groupBy("part").agg(F.count("*").alias("found"), F.first("size").alias("size"), F.min(F.struct("n", "piece")).alias("_r")).where("found = size").select("part", "_r.piece")
    return rarest.join(held, "piece").where(F.col("whole").contains(F.col("part"))).select("part", "whole")


def groups_of(col: Column) -> Column:
    """The numbers of the synonym groups of which a text holds a word."""
    return F.array_compact(F.array(*[F.when(col.rlike("|".join(group)), F.lit(i)) for i, group in enumerate(SYNONYMS)]))


def scores(evidence: DataFrame, positions: DataFrame, least_ids: int | None = None) -> DataFrame:
    """evidence: id, index, text. The best score of each (id, position) over all evidence, capped by index: 0 none, 1 90, others 75.

    Terms are scored per distinct term, so a term that many resumes share is matched once. The reason is that of the greatest score, of
    equal ones that of the first term. least_ids: of the positions of a synonym group, which all score alike, only so many with the smallest ids are
    kept; those are the ones that can be among as many best ones, or tie.
    """
    terms = evidence.select("id", "index", F.explode(x.position_terms(F.col("text"))).alias("term"))
    names = positions.select("position_id", x.normalize_position(F.col("position_name")).alias("name")).where("name <> ''")
    asked, named = terms.select("term").distinct(), names.select("name").distinct()
    usable = asked.where(~F.col("term").isin(BROAD))
    found = lambda pairs, kind, score: pairs.join(names, "name").select("term", "position_id", F.lit(KINDS.index(kind)).alias("kind"), score.alias("score"))
    long = lambda c, other: F.when(F.char_length(c) >= 8, 95).otherwise(other)
    exact = found(asked.join(named, F.col("term") == F.col("name")), "exact", F.lit(100))
    contains = found(contained_in(named.select(F.col("name").alias("part")), usable.select(F.col("term").alias("whole"))).select(F.col("whole").alias("term"), F.col("part").alias("name")), "contains", long("name", 90))
    contained = found(contained_in(usable.select(F.col("term").alias("part")), named.select(F.col("name").alias("whole"))).select(F.col("part").alias("term"), F.col("whole").alias("name")), "contained", long("term", 85))
    kin = names.select("position_id", F.explode(groups_of(F.col("name"))).alias("group"))
    if least_ids is not None:
        kin = kin.withColumn("_n", F.row_number().over(Window.partitionBy("group").orderBy("position_id"))).where(F.col("_n") <= least_ids)
    synonym = asked.select("term", F.explode(groups_of(F.col("term"))).alias("group")).join(kin, "group").select("term", "position_id", F.lit(KINDS.index("synonym")).alias("kind"), F.lit(80).alias("score"))
    known = reduce(DataFrame.union, [exact, contains.select(*exact.columns), contained.select(*exact.columns), synonym]).groupBy("term", "position_id").agg(F.max(F.struct("score", (-F.col("kind")).alias("less"))).alias("_s"))
    known = known.select("term", "position_id", "_s.score", F.get(F.lit(KINDS), -F.col("_s.less")).alias("reason"))
    cap = F.when(F.col("index") == 0, 100).when(F.col("index") == 1, 90).otherwise(75)
    return terms.join(known, "term").withColumn("score", F.least("score", cap).cast("int")).groupBy("id", "position_id").agg(F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), "term", "reason")).alias("_why")).select("id", "position_id", "score", F.concat_ws(": ", "_why.reason", "_why.term").alias("reason"))


def decide(scored: DataFrame, ids: DataFrame, least: int, positions: DataFrame, best_only: bool = False) -> DataFrame:
    """Per id: status, matched_position_id, the reason of the match, best score and the five best candidates (best_only: those with the best score)."""
    none_there = positions.isEmpty()
    order = Window.partitionBy("id").orderBy(F.desc("score"), "position_id")
    ranked = scored.withColumn("_n", F.row_number().over(order)).withColumn("_best", F.max("score").over(Window.partitionBy("id"))).withColumn("_tied", F.count(F.when(F.col("score") == F.col("_best"), 1)).over(Window.partitionBy("id")))
    listed = ranked.where((F.col("_n") <= SHOWN) & (F.col("score") == F.col("_best") if best_only else F.lit(True)))
    top = listed.groupBy("id").agg(F.max("_best").alias("score"), F.max("_tied").alias("tied"), F.min(F.when(F.col("_n") == 1, F.col("position_id"))).alias("first"), F.min(F.when(F.col("_n") == 1, F.col("reason"))).alias("why"), F.transform(F.sort_array(F.collect_list(F.struct("_n", "position_id"))), lambda c: c["position_id"]).alias("candidates"))
    rows = ids.join(top, "id", "left")
    status = F.when(~F.col("provided"), "notProvided").when(F.lit(none_there), "noPositions").when(F.col("score").isNull(), "noMatch").when(F.col("score") < least, "lowConfidence").when(F.col("tied") > 1, "ambiguous").otherwise("matched")
    return rows.select("id", status.alias("status"), F.when(status == "matched", F.col("first")).alias("matched_position_id"), F.when(status == "matched", F.col("why")).alias("reason"), "score", F.coalesce("candidates", F.array().cast("array<bigint>")).alias("candidates"))


def match_positions(texts: DataFrame, positions: DataFrame) -> DataFrame:
    """texts: id, text. One text per id. Candidates are the positions with the best score: one if matched, up to five if ambiguous."""
    given = texts.select("id", x.clean(F.col("text")).alias("text"))
    ids = given.select("id", F.col("text").isNotNull().alias("provided"))
    return decide(scores(given.where("text IS NOT NULL").withColumn("index", F.lit(0)), positions, SHOWN), ids, 0, positions, best_only=True)


def match_resume_positions(evidence: DataFrame, positions: DataFrame) -> DataFrame:
    """evidence: id, fields (array of texts in order of weight). Blank fields go before places are counted."""
    given = evidence.select("id", F.filter(F.transform("fields", x.clean), lambda v: v.isNotNull()).alias("fields"))
    ids = given.select("id", (F.size("fields") > 0).alias("provided"))
    return decide(scores(given.select("id", F.posexplode("fields").alias("index", "text")), positions, SHOWN), ids, 80, positions)


def section_number(value: Column) -> Column:
    """A section number without its chapter; null if blank."""
    return F.nullif(x.strip(F.regexp_replace(x.strip(value), r"^3\.", "")), F.lit(""))


def short_pieces(col: Column) -> Column:
    """The distinct runs of one to three letters of a text."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.char_length(col) - n + 1), lambda i: F.substring(col, i, n))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(F.char_length(col) >= n, runs(n)) for n in range(1, PIECE)]))))


def within(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """Pairs (part, whole) of distinct texts where a part of any length lies within a whole; an empty one lies within all."""
    short = parts.where(F.char_length("part") < PIECE)
    held = wholes.select("whole", F.explode(F.concat(F.array(F.lit("")), short_pieces(F.col("whole")))).alias("part"))
    return contained_in(parts.where(F.char_length("part") >= PIECE), wholes).unionByName(short.join(held, "part").select("part", "whole"))


def select_job_description(positions: DataFrame, sections: DataFrame) -> DataFrame:
    """positions: position_id, position_name and, where one is asked for, section_number. sections: number, title; sections in order of number.

    An explicit number must be found. Else the first section whose title equals, contains or is contained in the name; else the one whose number is the id.
    Distinct names meet distinct titles by pieces of their texts, so positions and sections are never paired.
    """
    asked = section_number(F.col("section_number").cast("string")) if "section_number" in positions.columns else F.lit(None).cast("string")
    names = positions.select("position_id", x.lower_tight(F.col("position_name")).alias("name"), asked.alias("asked"))
    heads = sections.where("number IS NOT NULL").select("number", x.lower_tight(F.col("title")).alias("head"))
    first = heads.groupBy("head").agg(F.min("number").alias("number"))
    titles, wanted = first.select("head"), names.where("asked IS NULL").select("name").distinct()
    pairs = within(titles.select(F.col("head").alias("part")), wanted.select(F.col("name").alias("whole"))).select(F.col("part").alias("head"), F.col("whole").alias("name"))
    pairs = pairs.unionByName(within(wanted.select(F.col("name").alias("part")), titles.select(F.col("head").alias("whole"))).select(F.col("whole").alias("head"), F.col("part").alias("name")))
    by_name = pairs.join(first, "head").groupBy("name").agg(F.min("number").alias("_named"))
    by_number = heads.select(F.col("number").cast("string").alias("_own"), "number").groupBy("_own").agg(F.min("number").alias("_numbered"))
    # the number that counts beside the name: the one asked for, or the id
    rows = names.withColumn("_own", F.coalesce("asked", F.col("position_id").cast("string"))).join(by_number, "_own", "left").join(by_name, "name", "left")
    section = F.when(F.col("asked").isNotNull(), F.col("_numbered")).otherwise(F.coalesce("_named", "_numbered"))
    return rows.select("position_id", section.alias("section")).select("position_id", "section", F.when(F.col("section").isNull(), "no section").alias("error"))


def criteria_input(resumes: DataFrame, matches: DataFrame, chosen: DataFrame, sections: DataFrame) -> DataFrame:
    """resumes: id, parsed (JSON text). Without personal fields, with the text of the matched position's job description; null where there is none."""
    rows = resumes.join(matches.select("id", "matched_position_id"), "id", "left").join(chosen, F.col("matched_position_id") == F.col("position_id"), "left").join(sections.select(F.col("number").alias("section"), "body"), "section", "left")
    return rows.select("id", F.when(F.col("body").isNotNull(), x.drop_sensitive_fields(F.col("parsed"))).alias("resume"), F.col("body").alias("description"))
