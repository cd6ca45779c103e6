"""Sanitising of personal data and of the terms that reveal it.

Protected entities are e-mail and network addresses, card and phone numbers. How
strongly a term reveals an entity is estimated from the corpus: the pointwise mutual
information of term and entity as a share of the entity's information content. It is
1 for a term that occurs only where the entity does, and near 0 for a common word. In
documents that hold the entity, terms above one threshold are generalised, terms above
a higher one are removed. A pair needs several different contexts as evidence, so that
copies of one text prove nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.llm.common import ascii_lower, bind, staged, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Per kind a test that every text with an entity passes, and the pattern of candidates. Lookbehind and possessive
#: repeats change no match; they keep long runs of characters linear and off the stack.
PATTERNS = {
    "email": (
        r"@[A-Za-z0-9-]",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    ),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LETTER = r"A-Za-z\x{80}-\x{10FFFF}"
TERMS = r"[a-z\x{80}-\x{10FFFF}]{3,}"
#: Code points on either side of an entity in which terms count as near.
REACH = 60
#: Different contexts in which a term must stand near an entity.
MIN_CONTEXTS = 3
#: Shares of an entity's information from which a term is generalised, and removed.
GENERALISE = 0.9
REMOVE = 0.97

DOC = ("k1", "k2")
PLACES = "array<struct<kind:string,i:int,gap:int,value:string,before:string,after:string>>"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of both; equal rows have equal results."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text", "doc_id").alias("k1"),
        F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"),
        "text",
    )


def _candidates(docs: DataFrame) -> DataFrame:
    """The rows that may hold an entity."""
    some = F.lit(False)
    for test, _ in PATTERNS.values():
        some = some | _text().rlike(test)
    return docs.where(some)


def _places(kind: str, pattern: Column) -> Column:
    """All matches of a pattern in ``text`` with the length of the gap before each, and what stands around it."""
    none = F.array().cast(PLACES)

    def listed(found: Column) -> Column:
        pieces = F.split(_text(), pattern, -1)
        every = bind(
            pieces,
            lambda p: F.transform(
                found,
                lambda v, i: F.struct(
                    F.lit(kind).alias("kind"),
                    i.alias("i"),
                    F.length(F.get(p, i)).alias("gap"),
                    v.alias("value"),
                    F.right(F.get(p, i), F.lit(REACH)).alias("before"),
                    F.left(F.get(p, i + 1), F.lit(REACH)).alias("after"),
                ),
            ),
        )
        return F.when(F.size(found) == 0, none).otherwise(every)

    return bind(F.regexp_extract_all(_text(), pattern, F.lit(0)), listed).cast(PLACES)


def _spans(rows: DataFrame) -> DataFrame:
    """One row per place and different document, with start, end and ``copies``, the number of equal rows."""
    names = ("gap", "value", "before", "after")
    once = rows.groupBy(*DOC, "kind", "i").agg(
        F.max(F.struct(*names)).alias("p"), F.count(F.lit(1)).alias("copies")
    )
    so_far = W.partitionBy(*DOC, "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    long = F.length("p.value").cast("long")
    end = F.sum(F.col("p.gap").cast("long") + long).over(so_far)
    return once.select(
        *DOC, "copies", "kind", (end - long).alias("start"), end.alias("end"), "p.value", "p.before", "p.after"
    )


def luhn(digits: Column) -> Column:
    """Whether the check digit of a number fits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    part = lambda x: F.regexp_replace(x, "^0+", "")
    byte = lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255"))
    return (
        F.when(kind == "ip", F.forall(F.split(value, r"\."), byte))
        .when(kind == "card", F.when((n >= 16) & (n <= 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", (n >= 8) & (n <= 15))
        .otherwise(True)
    )


def entities(docs: DataFrame) -> DataFrame:
    """Every protected entity of every text: document, kind, start, end (code points), value and what stands around it.

    Equal rows (doc_id and text) give one set of rows with ``copies`` as their number.
    """
    none = F.array().cast(PLACES)
    found = [
        F.when(_text().rlike(test), _places(kind, F.lit(pattern))).otherwise(none)
        for kind, (test, pattern) in PATTERNS.items()
    ]
    rows = _keyed(_candidates(docs)).select(*DOC, F.explode(F.concat(*found)).alias("p")).select(*DOC, "p.*")
    return _spans(rows).where(_valid(F.col("kind"), F.col("value")))


def _contexts(spans: DataFrame) -> DataFrame:
    """(document, copies, entity, context): what stands around each entity, without addresses and cut words."""
    word = r"[^\x20\x09-\x0D]*"
    cut = lambda c, at: F.when(F.length(c) == REACH, F.regexp_replace(c, at, "")).otherwise(F.col(c))
    around = F.concat(cut("before", rf"\A{word}"), F.lit(" "), cut("after", rf"{word}\z"))
    digits = F.regexp_replace("value", "[^0-9]", "")
    value = F.when(F.col("kind").isin("card", "phone"), digits).otherwise(ascii_lower(F.col("value")))
    return spans.select(
        *DOC,
        "copies",
        F.concat("kind", F.lit(":"), value).alias("entity"),
        ascii_lower(F.regexp_replace(around, f"{word}@{word}", " ")).alias("context"),
    )


def term_documents(docs: DataFrame) -> DataFrame:
    """(term, n_t): in how many rows a term occurs."""
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(_text()), F.lit(TERMS), F.lit(0)))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosures(
    docs: DataFrame, spans: DataFrame, min_contexts: int = MIN_CONTEXTS, generalise: float = GENERALISE
) -> DataFrame:
    """(entity, term, share) of the pairs whose term gives ``generalise`` or more of the entity's information.

    With N rows, of which n_e hold the entity, n_t the term, and n_et the term near
    the entity, the share is log(N n_et / (n_e n_t)) / log(N / n_e). An entity in all
    rows has no information to protect.
    """
    pair = ["entity", "term"]
    around = _contexts(spans)
    terms = F.array_distinct(F.regexp_extract_all("context", F.lit(TERMS), F.lit(0)))
    near = around.withColumn("term", F.explode(terms))
    contexts = near.select(*pair, "context").distinct().groupBy(*pair).agg(F.count(F.lit(1)).alias("contexts"))
    together = near.select(*pair, *DOC, "copies").distinct().groupBy(*pair).agg(F.sum("copies").alias("n_et"))
    holding = around.select("entity", *DOC, "copies").distinct().groupBy("entity").agg(F.sum("copies").alias("n_e"))
    pairs = staged(
        contexts.where(F.col("contexts") >= min_contexts).join(together, pair).join(holding, "entity"), "sanitise-pairs"
    )
    total = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    n, n_e, n_t, n_et = (F.col(c).cast("double") for c in ("n", "n_e", "n_t", "n_et"))
    share = F.log((n * n_et) / (n_e * n_t)) / F.log(n / n_e)
    return (
        pairs.join(term_documents(docs), "term")
        .crossJoin(F.broadcast(total))
        .where(n > n_e)
        .select(*pair, share.alias("share"))
        .where(F.col("share") >= generalise)
    )


def _revealing(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per document with an entity that some term reveals, the patterns of all such terms and of the removed ones.

    A document has at most the terms near its own entities.
    """
    held = _contexts(spans).select(*DOC, "entity").distinct()
    terms = held.join(pairs, "entity").groupBy(*DOC).agg(
        F.sort_array(F.collect_set("term")).alias("terms"),
        F.sort_array(F.collect_set(F.when(F.col("share") >= REMOVE, F.col("term")))).alias("removed"),
    )

    def pattern(c: str) -> Column:
        tags = "|".join(k.upper() for k in (*KINDS, TERM))
        words = F.array_join(c, "|")
        return F.concat(F.lit(rf"(?<![{LETTER}])(?!(?:{tags})\])(?i:"), words, F.lit(f")(?![{LETTER}])"))

    return terms.select(
        *DOC, pattern("terms").alias("terms"), F.when(F.size("removed") > 0, pattern("removed")).alias("removed")
    )


def term_spans(docs: DataFrame, spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Start and end of every revealing term in whole texts, outside the entities themselves."""
    texts = _keyed(_candidates(docs)).join(_revealing(spans, pairs), list(DOC))
    rows = texts.select(*DOC, F.explode(_places(TERM, F.col("terms"))).alias("p"))
    terms = _spans(rows.select(*DOC, "p.*")).select(*DOC, "copies", "kind", "start", "end")
    both = terms.unionByName(spans.select(*DOC, "copies", "kind", "start", "end"))
    base = F.col("kind") != TERM
    order = W.partitionBy(*DOC).orderBy("start", "end")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return both.withColumn("free", free).where(~base & F.col("free")).drop("free")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end in code points) of every row, by kind as in ``KINDS``, terms last, then start.

    Null and empty texts, and texts without an entity, have no spans: terms count only
    where the entity stands that they reveal. Rows that share a doc_id are documents of
    their own; equal rows have equal spans. No rows give none; other columns are ignored.
    """
    base = staged(entities(docs), "sanitise-entities")
    pairs = staged(disclosures(docs, base), "sanitise-disclosures")
    place = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), F.col("kind"))
    found = (
        base.select(*DOC, "kind", "start", "end")
        .unionByName(term_spans(docs, base, pairs).select(*DOC, "kind", "start", "end"))
        .groupBy(*DOC)
        .agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind"))).alias("spans"))
    )
    none = F.array().cast("array<struct<place:bigint,start:bigint,end:bigint,kind:string>>")
    spans = F.transform(F.coalesce("spans", none), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return _keyed(docs).drop("text").join(found, list(DOC), "left").select("doc_id", spans.alias("spans"))


def _tagged(kind: str) -> Column:
    """``text`` with a tag in place of every entity of a kind."""
    test, pattern = PATTERNS[kind]
    tag = F.lit(f"[{kind.upper()}]")

    def rebuilt(found: Column) -> Column:
        shown = F.transform(found, lambda v: F.when(_valid(F.lit(kind), v), tag).otherwise(v))
        pieces = F.split("text", pattern, -1)
        return F.array_join(F.flatten(F.zip_with(pieces, shown, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")

    every = bind(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), rebuilt)
    return F.when(F.col("text").rlike(test), every).otherwise(F.col("text"))


def sanitise(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``; in ``text`` entities give way to ``[EMAIL]`` and so on, terms to ``[TERM]`` or to nothing.

    A null text becomes an empty one. Where entities overlap, the first of ``KINDS`` wins.
    """
    base = staged(entities(docs), "sanitise-entities")
    pairs = staged(disclosures(docs, base), "sanitise-disclosures")
    found = _revealing(base, pairs).select(*[F.col(c).alias(f"_{c}") for c in (*DOC, "terms", "removed")])
    key = [F.xxhash64("text", F.col("doc_id").cast("long")), F.xxhash64(F.lit(1), "text", F.col("doc_id").cast("long"))]
    out = docs.join(found, (key[0] == F.col("_k1")) & (key[1] == F.col("_k2")), "left").withColumn("text", _text())
    for kind in KINDS:
        out = out.withColumn("text", _tagged(kind))
    for terms, tag in (("_removed", ""), ("_terms", f"[{TERM.upper()}]")):
        out = out.withColumn(
            "text",
            F.when(F.col(terms).isNotNull(), F.regexp_replace("text", F.col(terms), F.lit(tag))).otherwise(F.col("text")),
        )
    return out.select(*docs.columns)


def op11_sanitise(spark, sf_dir: str) -> DataFrame:
    """Counts and places of personal data and of the terms that reveal it, in all documents."""
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        number(TERM).alias("n_term"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), split AS (
@SPLIT@
), places AS (
  SELECT r, kind, place, i, m[i] AS value, p[i] AS gap, p[i + 1] AS after
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM split)
), located AS (
  SELECT *, sum(length(gap) + length(value)) OVER (PARTITION BY r, kind ORDER BY i) AS stop,
         regexp_replace(value, '[^0-9]', '', 'g') AS digits
  FROM places
), base AS (
  SELECT r, kind, place, stop - length(value) AS start, stop, value, digits, right(gap, 60) AS before, left(after, 60) AS after
  FROM located
  WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(value, '.'),
           lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(digits)), lambda k:
           CASE WHEN k % 2 = 0 THEN substr(digits, length(digits) - k, 1)::INT
                ELSE 2 * substr(digits, length(digits) - k, 1)::INT
                     - 9 * (substr(digits, length(digits) - k, 1) > '4')::INT END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15 ELSE true END
), contexts AS (
  SELECT r, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits
           ELSE translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS entity,
         translate(regexp_replace(
             CASE WHEN length(before) = 60 THEN regexp_replace(before, '\A[^\x20\x09-\x0D]*', '') ELSE before END || ' ' ||
             CASE WHEN length(after) = 60 THEN regexp_replace(after, '[^\x20\x09-\x0D]*\z', '') ELSE after END,
             '[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*', ' ', 'g'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS context
  FROM base
), near AS (
  SELECT DISTINCT r, entity, context, term FROM (
    SELECT *, unnest(regexp_extract_all(context, '[a-z\x{80}-\x{10FFFF}]{3,}')) AS term FROM contexts)
), pairs AS (
  SELECT entity, term, count(DISTINCT r) AS n_et FROM near GROUP BY ALL HAVING count(DISTINCT context) >= 3
), holding AS (
  SELECT entity, count(DISTINCT r) AS n_e FROM contexts GROUP BY ALL
), known AS (
  SELECT term, count(DISTINCT r) AS n_t
  FROM (SELECT r, unnest(regexp_extract_all(low, '[a-z\x{80}-\x{10FFFF}]{3,}')) AS term FROM d) GROUP BY ALL
), n AS (
  SELECT count(*)::DOUBLE AS n FROM documents
), revealing AS (
  SELECT entity, term FROM pairs JOIN holding USING (entity) JOIN known USING (term), n
  WHERE n > n_e AND ln((n * n_et) / (n_e::DOUBLE * n_t)) / ln(n / n_e) >= 0.9
), wanted AS (
  SELECT DISTINCT r, revealing.term FROM contexts JOIN revealing USING (entity)
), words AS (
  SELECT r, i, w[i] AS term, length(p[i]) + length(w[i]) AS step
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(low, '[a-z\x{80}-\x{10FFFF}]{3,}') AS w,
           string_split_regex(low, '[a-z\x{80}-\x{10FFFF}]{3,}') AS p
    FROM d WHERE r IN (SELECT r FROM wanted)))
), standing AS (
  SELECT r, term, sum(step) OVER (PARTITION BY r ORDER BY i) AS stop FROM words
), terms AS (
  SELECT r, 'term' AS kind, 5 AS place, stop - length(term) AS start, stop
  FROM standing s SEMI JOIN wanted USING (r, term)
  WHERE NOT EXISTS (FROM base b WHERE b.r = s.r AND b.start < s.stop AND s.stop - length(s.term) < b.stop)
), every AS (
  SELECT r, kind, place, start::BIGINT AS start, stop::BIGINT AS stop FROM base
  UNION ALL SELECT r, kind, place, start::BIGINT, stop::BIGINT FROM terms
), told AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         count(*) FILTER (kind = 'term') AS n_term,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (place < 5) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) AS spans
  FROM every GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip,
       coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       coalesce(n_term, 0)::BIGINT AS n_term, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
""".replace(
    "@SPLIT@",
    " UNION ALL\n".join(
        f"  SELECT r, '{k}' AS kind, {n} AS place, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM d"
        for n, k, p in (
            (1, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            (2, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            (3, "card", r"[0-9]([\x20-]?[0-9])+"),
            (4, "phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        )
    ),
)
