"""Secret scans judged by corpus-wide ownership, with DataFrame functions only.

Candidates come from patterns: the base kinds assign, access and hex, and bare mixed tokens (long runs with
letters and digits).  Each candidate's value is hashed, and the hashes are aggregated over the corpus by distinct
repositories (documents) and distinct owners (sources).  A value that many owners hold, or many repositories even
of one owner, is a widely copied example; one that one or two owners hold in few repositories, and that looks
random, is live-looking.  Base spans are always returned; a bare token is added as kind `owned` only if
its value is live-looking and no base span covers it.

Positions: the text between matches is what `split` leaves, so the k-th match starts after the first k gaps
and k-1 matches.  A pattern is split only where it occurs.

Counting is two partial aggregations (by hash and owner, then by hash), so a value that a third of all
documents hold is no hot key; the join that brings verdicts back can be split by adaptive execution.

Defined results: a null text counts as empty; a null source is an owner of its own; repeated rows (same key
and text) are one repository, and each gives a row; rows with the same key and other texts are judged apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import stash, text_or_empty

#: The base patterns.  The least lengths hold for the whole match, or for group 2 of assign.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Bare tokens: runs of these characters, so long, that hold letters and digits.
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "owned")
#: A value with more owners, or in more repositories (even of one owner), is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 4, 10
#: A value with at most so many owners, that looks random, is live-looking.
LIVE_OWNERS = 2
#: A live-looking value has at least so many characters and so many different ones.
LIVE_LENGTH, LIVE_VARIETY = 16, 8
#: Spans gathered before they are put with the rest.
FEW = 256
_SPAN = "struct<start:int,place:int,end:int,kind:string,value:string>"
_NO_SPANS = f"cast(array() as array<{_SPAN}>)"


def _spans(text: str, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Array of (start, place, end, kind, value) of the pattern's leftmost non-overlapping matches, in code points.

    place is the kind's rank, so spans sort by their first two fields.
    """
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    found = f"regexp_extract_all({text}, {p}, 0)"
    values = found if group == 0 else f"regexp_extract_all({text}, {p}, {group})"
    # a fold over the matches keeps the end of the last one.  Arrays that grow are copied at each step, so spans are
    # gathered FEW at a time; one-element transforms bind what is used twice
    span = f"struct(s.at + x.g[i] as start, {KINDS.index(kind)} as place, s.at + x.g[i] + length(x.m[i]) as end, '{kind}' as kind, x.v[i] as value)"
    few = f"aggregate(sequence(j * {FEW}, least(size(x.m), (j + 1) * {FEW}) - 1), struct(all.at as at, {_NO_SPANS} as spans), (s, i) -> struct(s.at + x.g[i] + length(x.m[i]) as at, array_append(s.spans, {span}) as spans))"
    fold = f"flatten(aggregate(sequence(0, (size(x.m) - 1) div {FEW}), struct(0 as at, cast(array() as array<array<{_SPAN}>>) as parts), (all, j) -> transform(array({few}), r -> struct(r.at as at, array_append(all.parts, r.spans) as parts))[0]).parts)"
    bound = f"transform(array(struct(transform(split({text}, {p}), g -> length(g)) as g, {found} as m, {values} as v)), x -> {fold})[0]"
    return F.expr(f"case when {text} rlike {p} then filter({bound}, s -> length(s.value) >= {least}) else {_NO_SPANS} end")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, owner, mark, base, bare, hashes): for each row of docs its base spans and its bare tokens, in order of position, and the hashes of the values of both.

    mark tells rows of the same key apart by text.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("owner"), text_or_empty(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    found = rows.select(
        "key", "owner", "mark",
        F.array_sort(F.concat(_spans("text", "assign", ASSIGN, 2, 6), _spans("text", "access", ACCESS), _spans("text", "hex", HEX))).alias("base"),
        _spans("text", "owned", TOKEN).alias("bare"),
    )
    # hexadecimal runs and access keys lie inside one token, so the token's text tells of them; only assignments are asked by place
    free = f"not t.value rlike '{HEX}' and not t.value rlike '{ACCESS}' and not exists(keyed, s -> s.start < t.end and t.start < s.end)"
    found = found.withColumn("keyed", F.filter("base", lambda s: s["kind"] == "assign")).withColumn("bare", F.expr(f"filter(bare, t -> t.value rlike '[A-Za-z]' and t.value rlike '[0-9]' and {free})")).drop("keyed")
    return found.withColumn("hashes", F.transform(F.concat("base", "bare"), lambda s: _hash(s["value"])))


def _hash(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories): for each candidate value, by how many distinct owners and documents it is held."""
    held = found.select("key", "mark", "owner", F.explode("hashes").alias("hash"))
    return held.groupBy("hash", "owner", "key", "mark").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, base, spans) for each row of docs.

    base: array of (start, place, end, kind, value); spans: array of (start, place, end, kind, value, owners,
    repositories, verdict), base spans and owned tokens by start, then kind.  verdict is `example` if more than
    EXAMPLE_OWNERS owners or EXAMPLE_REPOSITORIES repositories hold the value, `live` if it looks random and at most
    LIVE_OWNERS owners hold it, else `unsure`.
    """
    found = stash(candidates(docs, key, text, source), "candidates")
    held = found.where(F.size("hashes") > 0).select("key", "mark", F.posexplode("hashes").alias("nth", "hash")).distinct()
    told = held.join(ownership(found), "hash").groupBy("key", "mark").agg(F.array_sort(F.collect_list(F.struct("nth", "owners", "repositories"))).alias("told"))
    told = told.withColumnRenamed("key", "k").withColumnRenamed("mark", "m")
    out = found.join(told, found["key"].eqNullSafe(told["k"]) & (found["mark"] == told["m"]), "left")
    met = F.zip_with(F.concat("base", "bare"), F.coalesce("told", F.array().cast("array<struct<nth:int,owners:bigint,repositories:bigint>>")), lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    out = out.select(F.col("key").alias(key), "base", met.alias("met"))
    looks_live = f"length(x.s.value) >= {LIVE_LENGTH} and size(array_distinct(split(x.s.value, ''))) >= {LIVE_VARIETY}"
    judged = f"""transform(met, x -> named_struct('start', x.s.start, 'place', x.s.place, 'end', x.s.end, 'kind', x.s.kind, 'value', x.s.value, 'owners', x.t.owners, 'repositories', x.t.repositories,
        'verdict', case when x.t.owners > {EXAMPLE_OWNERS} or x.t.repositories > {EXAMPLE_REPOSITORIES} then 'example' when x.t.owners <= {LIVE_OWNERS} and {looks_live} then 'live' else 'unsure' end))"""
    return out.select(key, "base", F.expr(f"array_sort(filter({judged}, s -> s.kind <> 'owned' or s.verdict = 'live'))").alias("spans"))


def joined(column: str) -> Column:
    return F.array_join(F.transform(F.col(column), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(docs: DataFrame, **names) -> DataFrame:
    """One row per row of docs: counts by base kind, digests of the base spans, all spans, and counts of verdicts."""
    count = lambda c, field, v: F.size(F.filter(F.col(c), lambda s: s[field] == v)).cast("long")
    key = names.get("key", "doc_id")
    return scan(docs, **names).select(
        key,
        *[count("base", "kind", k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        count("spans", "verdict", "live").alias("n_live"),
        count("spans", "verdict", "example").alias("n_example"),
    )


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", instead: str = "<secret>") -> DataFrame:
    """docs with every base span and every owned token replaced in the text; all else stays."""
    rows = docs.withColumn("__mark", F.xxhash64(text_or_empty(text)))
    # where spans overlap, the longest reach is replaced once
    merged = """aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (acc, s) ->
        case when size(acc) > 0 and element_at(acc, -1).end >= s.start
             then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end))))
             else array_append(acc, named_struct('start', s.start, 'end', s.end)) end)"""
    found = scan(docs.withColumn("__key", F.struct(F.col(key).alias("k"), F.xxhash64(text_or_empty(text)).alias("m"))), "__key", text, source).where(F.size("spans") > 0)
    found = found.select(F.col("__key.k").alias("__k"), F.col("__key.m").alias("__m"), F.expr(merged).alias("__cuts")).dropDuplicates(["__k", "__m"])
    out = rows.join(found, rows[key].eqNullSafe(found["__k"]) & (rows["__mark"] == found["__m"]), "left")
    cut = f"""concat_ws('', transform(sequence(0, size(__cuts)), i -> concat(
        substring(`{text}`, if(i = 0, 1, __cuts[i - 1].end + 1), if(i = size(__cuts), length(`{text}`), __cuts[i].start) - if(i = 0, 0, __cuts[i - 1].end)),
        if(i = size(__cuts), '', '{instead}'))))"""
    return out.withColumn(text, F.expr(f"case when __cuts is null then `{text}` else {cut} end")).select(*docs.columns)


def _oracle() -> str:
    def spans(kind: str, pattern: str, group: int, least: int) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return f"""SELECT doc_id, owner, mark, '{kind}' AS kind, s.lo AS lo, s.lo + len(s.m) AS hi, s.v AS value FROM (
      SELECT doc_id, owner, mark, unnest([{{'lo': list_sum([len(x) FOR x IN g[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i-1]]), 0), 'm': m[i], 'v': v[i]}} FOR i IN range(1, len(m) + 1)]) AS s
      FROM (SELECT doc_id, owner, mark, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v FROM docs WHERE regexp_matches(text, {p})))
    WHERE len(s.v) >= {least}"""

    return f"""
WITH docs AS (SELECT doc_id, source AS owner, coalesce(text, '') AS text, hash(coalesce(text, '')) AS mark FROM documents),
base AS ({spans("assign", ASSIGN, 2, 6)} UNION ALL {spans("access", ACCESS, 0, 1)} UNION ALL {spans("hex", HEX, 0, 1)}),
bare AS (
  SELECT * FROM ({spans("owned", TOKEN, 0, 1)}) t
  WHERE regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.mark = t.mark AND b.lo < t.hi AND t.lo < b.hi)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owners AS (SELECT value, count(DISTINCT coalesce(owner, chr(1))) AS owners, count(DISTINCT (coalesce(doc_id::VARCHAR, ''), mark)) AS repositories FROM every GROUP BY value),
judged AS (
  SELECT e.*, list_position({[*BASE, "owned"]}, kind) AS place, CASE WHEN o.owners > {EXAMPLE_OWNERS} OR o.repositories > {EXAMPLE_REPOSITORIES} THEN 'example'
    WHEN o.owners <= {LIVE_OWNERS} AND len(value) >= {LIVE_LENGTH} AND len(list_distinct(string_split(value, ''))) >= {LIVE_VARIETY} THEN 'live' ELSE 'unsure' END AS verdict
  FROM every e JOIN owners o USING (value)),
told AS (
  SELECT doc_id, mark,
    count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, place) FILTER (WHERE kind <> 'owned') AS base,
    string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, place) FILTER (WHERE kind <> 'owned' OR verdict = 'live') AS spans,
    count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example' AND kind <> 'owned') AS n_example
  FROM judged GROUP BY doc_id, mark)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs d LEFT JOIN told t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.mark = t.mark
"""


ORACLE = _oracle()
