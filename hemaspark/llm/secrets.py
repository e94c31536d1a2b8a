"""Secret scan with multipart credential linking. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, written
from .spans import joined, listed, merged, redacted, with_spans

#: Parts of one credential stand at most so many code points from each other.
SCOPE = 240
#: Fixed patterns: strong candidates are reported always.
STRONG = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
#: Weak candidates count only with a complementary part in their scope: what identifies, what is secret, where it works.
WEAK = {
    "identifier": r"""(?:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?|User(?:name|_?[Ii]d)?|Login|Account|Client_?[Ii]d|Access_?[Kk]ey(?:_?[Ii]d)?|USER(?:NAME|_?ID)?|LOGIN|ACCOUNT|CLIENT_?ID|ACCESS_?KEY(?:_?ID)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "key": r"[A-Za-z0-9+/_-]{20,}={0,2}",
    "endpoint": r"""(?:(?:https?|ftps?|ssh|sftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3|jdbc:[a-z]{2,20})://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}|(?:host(?:name)?|endpoint|server|base_?url|Host(?:name)?|Endpoint|Server|Base_?[Uu]rl|HOST(?:NAME)?|ENDPOINT|SERVER|BASE_?URL)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})""",
}
#: Characters of which every match holds one.
NEEDS = {"assign": ":=", "access": "A", "identifier": ":=", "key": "0", "endpoint": ":="}
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
ORDER = {k: i for i, k in enumerate([*STRONG, *WEAK])}
KEEP = {
    "assign": lambda m: F.length(F.regexp_extract(m, r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)\z""", 1)) >= 6,
    "access": lambda m: F.length(m) >= 20,
    # A random key mixes all three kinds of characters; prose, paths and hexadecimal numbers don't.
    "key": lambda m: m.rlike("[0-9][^0-9]+[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]") & (F.length(F.regexp_replace(m, "[^A-Za-z]", "")) >= 6),
}


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, strong, weak): spans of each document as arrays, strong by start, then kind."""
    keys = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).alias("_text"))
    found = with_spans(keys, "_text", STRONG | WEAK, KEEP, NEEDS)
    every = lambda kinds: F.sort_array(F.concat(*[listed(F.col(f"_s_{k}"), k, ORDER[k], False) for k in kinds]))
    return found.select("_id", "_th", every(STRONG).alias("strong"), every(WEAK).alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_id, _th, more): the weak candidates of each document that a complementary part stands near.

    An interval join of the parts within a document by their order: of every role, the nearest part that begins before
    and the nearest that begins after are carried along, so each part meets at most two of a role, whatever the number of
    parts. A key or an identifier needs the other one, or a key an endpoint, and an endpoint a secret, within `scope` code
    points. Weak candidates that touch a strong one of the same role are the strong one.
    """
    parts = found.where(F.size("weak") > 0).select("_id", "_th", F.explode(F.concat("strong", "weak")).alias("p")).select("_id", "_th", "p.*").distinct()
    role = F.create_map(*[F.lit(x) for k, r in ROLE.items() for x in (k, r)])[F.col("kind")]
    parts = parts.withColumn("role", role).withColumn("strong", F.col("kind").isin(*STRONG))
    by = Window.partitionBy("_id", "_th")
    ahead = by.orderBy("start", "b", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = by.orderBy(F.col("start").desc(), F.col("b").desc(), F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)

    def gaps(name: str, among: Column) -> dict[str, Column]:
        return {f"{name}_l": F.col("start") - F.max(F.when(among, F.col("end"))).over(ahead), f"{name}_r": F.min(F.when(among, F.col("start"))).over(behind) - F.col("end")}

    near = parts.withColumns({k: v for r in ("secret", "identifier", "endpoint") for k, v in gaps(r, F.col("role") == r).items()} | gaps("strong", F.col("strong")))
    within = lambda r: F.coalesce(F.least(F.col(f"{r}_l"), F.col(f"{r}_r")) <= scope, F.lit(False))
    touches = F.coalesce(F.least("strong_l", "strong_r") < 0, F.lit(False))
    complete = F.when(F.col("role") == "secret", within("identifier") | within("endpoint")).when(F.col("role") == "identifier", within("secret")).otherwise(within("secret"))
    hit = near.where(~F.col("strong") & ~touches & complete)
    return hit.groupBy("_id", "_th").agg(F.sort_array(F.collect_set(F.struct("a", "b", "end", "kind", "start"))).alias("more"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id_col, _th, strong, more): each row's strong spans and the weak ones that were linked.

    _th is xxhash64 of the text, to tell rows with the same id apart. A null or empty text has no spans; repeated rows
    have the same spans each; a null id is kept; other columns are ignored. Regular expressions read whole texts in one
    pass over the input, whose spans are written; only documents with weak candidates are shuffled, as spans.
    """
    found = written(scanned(docs, id_col, text_col), "spans")
    more = linked(found, scope)
    rows = found.alias("f").join(more.alias("m"), F.expr("f._id <=> m._id and f._th = m._th"), "left")
    none = "array<struct<a:int,b:int,end:int,kind:string,start:int>>"
    return rows.select(F.col("f._id").alias(id_col), F.col("f._th").alias("_th"), "strong", F.coalesce("more", F.array().cast(none)).alias("more"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with every secret, strong or linked, replaced by <kind>; overlapping spans are replaced as one.

    No row goes, null texts stay null, ids may be null or repeat, other columns, whatever their names, are kept as they were. Time
    grows with the text and its spans, so a text may hold any number of them.
    """
    found = secret_spans(docs, id_col, text_col, scope).where("size(strong) + size(more) > 0")
    hits = found.select(F.col(id_col).alias("_id"), "_th", merged(F.sort_array(F.concat("strong", "more"))).alias("cut")).dropDuplicates(["_id", "_th"])
    rows = rows_of(docs, id_col, text_col).join(hits, F.expr("id <=> _id and th = _th"), "left")
    own = F.col("row").getField(text_col)
    text = F.when(F.col("cut").isNull(), own).otherwise(redacted(own, F.col("cut"), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">"))))
    return rows.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents, production parameters."""
    rows = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in STRONG], F.sha2(joined(F.col("strong")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("strong", "more"))).alias("spans"), F.size("more").cast("long").alias("n_linked"))


def _sql() -> str:
    """The query in DuckDB's SQL: the same patterns (a possessive quantifier is a greedy one there, as nothing follows it), positions
    from the pieces between matches, and links as conditions on pairs of parts of a document."""
    plain = {k: p.replace("++", "+").replace("}+", "}").replace("(?<![0-9a-f])", "") for k, p in (STRONG | WEAK).items()}
    keep = {
        "assign": """length(regexp_extract(m, '[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6""",
        "access": "length(m) >= 20",
        "key": "regexp_matches(m, '[0-9][^0-9]+[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND length(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= 6",
    }
    found = " UNION ALL ".join(
        f"""SELECT rid, '{k}' AS kind, {ORDER[k]} AS ord, '{ROLE[k]}' AS role, {k in STRONG} AS strong, b - length(m) AS a, b, m FROM (
          SELECT rid, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS b FROM (
            SELECT rid, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
              SELECT rid, regexp_extract_all(text, '{q}') AS ms, string_split_regex(text, '{q}') AS gs FROM t) WHERE len(ms) > 0)) WHERE {keep.get(k, 'true')}"""
        for k, q in ((k, p.replace("'", "''")) for k, p in plain.items())
    )
    need = "(w.role = 'secret' AND o.role IN ('identifier', 'endpoint') OR w.role <> 'secret' AND o.role = 'secret')"
    near = "(CASE WHEN (o.a, o.ord, o.b) < (w.a, w.ord, w.b) THEN w.a - o.b ELSE o.a - w.b END)"
    listing = "coalesce(string_agg(concat_ws(':', kind, a, b), ',' ORDER BY a, ord, b){}, '')"
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({found}),
l AS (SELECT * FROM p w WHERE NOT strong AND EXISTS (SELECT 1 FROM p o WHERE o.rid = w.rid AND {need} AND {near} <= {SCOPE})
  AND NOT EXISTS (SELECT 1 FROM p o WHERE o.rid = w.rid AND o.strong AND {near} < 0)),
s AS (SELECT * FROM p WHERE strong UNION ALL SELECT * FROM l)
SELECT t.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in STRONG)},
  sha256({listing.format(" FILTER (WHERE strong)")}) AS base_sha256, {listing.format(" FILTER (WHERE kind IS NOT NULL)")} AS spans, count(*) FILTER (WHERE NOT strong) AS n_linked
FROM t LEFT JOIN s ON t.rid = s.rid GROUP BY t.rid, t.doc_id"""


SQL = _sql()
