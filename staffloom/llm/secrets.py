"""Secret scans with character Markov models, by DataFrame functions only.

Base spans come from three patterns. The method adds spans: every other run of 20 or more token
characters is scored by the log-likelihood ratio per transition of two first-order Markov models, one
of random strings and one of ordinary identifiers, and counts as a secret where the ratio passes
``threshold``. The models tell all 66 token characters apart.

The models are trained from labelled samples. Random: the values of base spans in the sampled documents, and strings drawn
from a hash over seven alphabets (base64, its URL form, letters and digits of either or both cases, hexadecimal digits of
either case). Ordinary: the words of the sampled documents, runs of them joined as identifiers are (snake, upper, kebab, camel, path), the
words of ``PARTS`` joined so, and numbers. The sample holds about ``sample_docs`` documents (ordinary words: a tenth of those), those
whose hashed id falls under a share of the whole hash range, so it is the same on any partitioning and doesn't run dry at any
size; ``drawn`` strings of each kind are made. All documents are scanned with the models.

Everything about a text is computed within its row: no join, and nothing is shuffled but the counts of
character pairs, of which at most 2 x 66 x 66 numbers reach the driver.

Defined results: a null or empty text has no span; a row with a null id is scanned, but not drawn for the sample; repeated
rows each get their own result; an empty table gives no rows; other columns pass through, but for columns named ``_text``, ``_base`` or
``_spans``, which are replaced.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffloom.llm.shared import let

# The base patterns by kind, in the order that breaks ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}+"
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]
KINDS = ["assign", "access", "hex", "markov"]

#: Runs that the models look at, and words that train the ordinary one.
RUN = r"\b[A-Za-z0-9+/_-]{20,}+"
ORDINARY = r"[A-Za-z0-9_-]{6,}"
#: Symbols of the models.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
# Words that identifiers are made of.
PARTS = """get set add put new old all any key map list item name user account group role type kind data date time value index count size
total start end begin first last next prev parent child root node path file folder dir line text word page table column row cell field
form input output result error message code status state event action handler listener service client server request response
session cookie header body query param option config setting default enable disable load save read write open close create update delete
remove insert find search sort filter merge split join parse format convert encode decode check test build run main util helper
manager factory builder provider controller view model order price amount product customer address email phone number id by and or of
to from in on with for without max min average sum""".split()
CHUNK = 256
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def running_sums(lengths: Column) -> Column:
    """Sums of an array up to and with each element, by chunks of 256, so that long arrays stay cheap."""
    every = lambda n, step: F.sequence(F.lit(0), n - 1, F.lit(step))
    chunks = lambda x: F.transform(every(F.size(x), CHUNK), lambda at: total(F.slice(x, at + 1, CHUNK)))
    before = lambda sums: F.transform(every(F.size(sums), 1), lambda i: total(F.slice(sums, F.lit(1), i)))
    within = lambda x, b: F.transform(every(F.size(x), 1), lambda i: F.get(b, (i / CHUNK).cast("int")) + total(F.slice(x, (i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK + 1)))
    return let(lengths, lambda x: let(let(chunks(x), before), lambda b: within(x, b)))


def with_matches(df: DataFrame, text: str, pattern: str, out: str, only: Column | None = None) -> DataFrame:
    """Adds an array of (start, end, hit) for all matches, in code points, end exclusive.

    The texts between matches and the matches are split off as two arrays; running sums of their
    lengths are the places. only: a cheap test that every text with a match passes.
    """
    hits, gaps, ends = f"{out}_h", f"{out}_g", f"{out}_e"
    every = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn(hits, every if only is None else F.when(only, every).otherwise(F.array().cast("array<string>")))
    some = F.size(hits) > 0
    df = df.withColumn(gaps, F.when(some, F.transform(F.split(F.col(text), pattern, -1), lambda g: F.char_length(g).cast("long"))))
    df = df.withColumn(ends, F.when(some, running_sums(F.zip_with(F.slice(gaps, 1, F.size(hits)), F.col(hits), lambda g, h: g + F.char_length(h)))))
    found = F.zip_with(F.col(hits), F.col(ends), lambda h, e: F.struct((e - F.char_length(h)).alias("start"), e.alias("end"), h.alias("hit")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    return df.withColumn(out, F.when(some, found).otherwise(none)).drop(hits, gaps, ends)


def with_base(df: DataFrame) -> DataFrame:
    """Adds ``_assign``, ``_access`` and ``_hex``: the base matches of each kind in ``_text``."""
    named = let(F.lower("_text"), lambda t: reduce(lambda a, b: a | b, [t.contains(k) for k in NAMES]))
    for kind, pattern, only in zip(KINDS, (ASSIGN, ACCESS, HEX), (named, F.col("_text").contains("AKIA"), None), strict=False):
        df = with_matches(df, "_text", pattern, f"_{kind}", only)
    return df.withColumn("_assign", F.filter("_assign", lambda m: F.char_length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 8))


def pairs(run: Column) -> Column:
    """The transitions of a run of symbols, as numbers below len(SYMBOLS)^2."""
    places = F.transform(F.split(run, ""), lambda c: F.position(c, F.lit(SYMBOLS)) - 1)
    steps = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * len(SYMBOLS) + b)
    return F.when(F.char_length(run) > 1, let(F.filter(places, lambda p: p >= 0), steps)).otherwise(F.array().cast("array<int>"))


def identifiers(parts: Column) -> Column:
    """An array of words joined in the forms of identifiers."""
    upper, capital = F.transform(parts, F.upper), F.transform(parts, lambda w: F.initcap(w))
    camel = F.concat(F.get(parts, F.lit(0)), F.array_join(F.slice(capital, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ""))
    return F.array(F.array_join(parts, "_"), F.array_join(upper, "_"), F.array_join(parts, "-"), F.array_join(capital, ""), camel, F.array_join(parts, "/"))


def random_strings(spark: SparkSession, drawn: int) -> DataFrame:
    """(v): strings drawn by hash over each alphabet, ``drawn`` of each."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    base = F.regexp_replace(F.base64(F.unhex(F.concat(digest("a"), digest("b")))), "[\\r\\n=]", "")
    plain = F.regexp_replace(base, "[+/]", "")
    kinds = [base, F.translate(base, "+/", "-_"), plain, F.lower(plain), F.upper(plain), digest("c"), F.upper(digest("d"))]
    return spark.range(drawn).select(F.explode(F.array(*kinds)).alias("v"))


def ordinary_strings(spark: SparkSession, drawn: int) -> DataFrame:
    """(v): identifiers of two to five words of PARTS, and numbers."""
    pick = lambda i: F.get(F.lit(PARTS), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(PARTS))).cast("int"))
    length = (F.pmod(F.xxhash64("id", F.lit("n")), F.lit(4)) + 2).cast("int")
    words_ = F.slice(F.array(*[pick(i) for i in range(5)]), F.lit(1), length)
    numbers = F.array(F.abs(F.xxhash64("id", F.lit("number"))).cast("string"))
    return spark.range(drawn).select(F.explode(F.concat(identifiers(words_), numbers)).alias("v"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 20_000, drawn: int = 4_000) -> list[float]:
    """Log-likelihood ratios of all transitions, random against ordinary."""
    share, whole = min(1.0, sample_docs / max(docs.count(), 1)), (1 << 63) - 1
    sampled = lambda part: docs.where(F.shiftrightunsigned(F.xxhash64(F.lit("markov"), F.col(key)), 1) <= min(int(part * whole), whole)).where(F.col(key).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    secret = F.concat(F.transform("_assign", lambda m: F.regexp_extract(m["hit"], ASSIGN, 2)), F.transform("_access", lambda m: m["hit"]), F.transform("_hex", lambda m: m["hit"]))
    found = with_base(sampled(share)).select(F.explode(secret).alias("v"))
    letters = F.regexp_extract_all(F.lower("_text"), F.lit("[a-z]{2,}"), F.lit(0))
    joined = let(letters, lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3)), lambda i: identifiers(F.slice(w, i, 3)))))
    words_ = sampled(share / 10).select(F.explode(F.concat(F.regexp_extract_all("_text", F.lit(ORDINARY), F.lit(0)), F.when(F.size(letters) > 2, joined).otherwise(F.array().cast("array<string>")))).alias("v"))
    random = found.union(random_strings(docs.sparkSession, drawn)).select(F.lit(1).alias("side"), "v")
    ordinary = words_.where(~F.col("v").rlike(HEX) & ~F.col("v").rlike(ACCESS)).union(ordinary_strings(docs.sparkSession, drawn)).select(F.lit(0).alias("side"), "v")
    values = random.union(ordinary).distinct()
    counts = values.select("side", F.explode(pairs(F.col("v"))).alias("pair")).groupBy("side", "pair").count().collect()  # at most 2 x 66 x 66 rows
    n = len(SYMBOLS)
    times = {0: [1] * (n * n), 1: [1] * (n * n)}
    for row in counts:
        times[row["side"]][row["pair"]] += row["count"]
    chance = {side: [c / sum(x[i // n * n : i // n * n + n]) for i, c in enumerate(x)] for side, x in times.items()}
    return [log(a / b) for a, b in zip(chance[1], chance[0], strict=True)]


def log_ratio(run: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a run per transition."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    return F.aggregate(pairs(run), F.lit(0.0), lambda a, p: a + F.get(table, p)) / F.greatest(F.char_length(run) - 1, F.lit(1))


def scan(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds ``_text`` (null: empty) and ``_base`` and ``_spans``, sorted arrays of (start, kind, end); kind is a place in KINDS."""
    own = [c for c in docs.columns if c not in ("_text", "_base", "_spans")]
    df = docs.select(F.struct(*own).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = with_matches(with_base(df), "_text", RUN, "_run")
    as_span = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    df = df.withColumn("_base", F.array_sort(F.concat(*[F.transform(f"_{k}", as_span(i)) for i, k in enumerate(KINDS[:3])])))
    free = lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))
    added = F.transform(F.filter("_run", lambda m: free(m) & (log_ratio(m["hit"], ratios) >= threshold)), as_span(3))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", added))).select("_row.*", "_text", "_base", "_spans")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.lit(KINDS)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, s: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(piece(a, s)).alias("out"))
    done = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, done)).otherwise(text)


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, sample_docs: int = 20_000) -> DataFrame:
    """Trains on the documents and scans all of them; see ``scan``."""
    return scan(docs, train(docs, key, text, sample_docs), text, threshold)
