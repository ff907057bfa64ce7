"""PII sanitisation by information content, in DataFrame operations only.

Protected entities are e-mail addresses, IP addresses, card and phone numbers
(base detection) and secrets (long runs that mix letters and digits).  Corpus
co-occurrence then estimates how strongly the words around an entity reveal
it.  With document counts n over all N documents, a word t near entity e
discloses the share

    log(n(t, e) N / (n(t) n(e))) / log(N / n(e))  *  k / (k + PRIOR)

of the entity's information: the first factor is 1 if t occurs nowhere else,
the second trusts few sightings less (k: documents that hold both, and once
more those that hold them near each other).  So an entity of one document is
judged as well, by neighbours that no other document has.  Near are the WINDOW
words before and after, up to the next candidate of the entity's kind, however
long they are; a term is a run of two or more letters and digits.  A word that
reaches the disclosure threshold becomes a span of kind ``term`` wherever it
occurs in the documents that hold the entity.  ``sanitise`` generalises
entities to their kind and removes such words.

The patterns run without backtracking over groups, so that long texts can
neither overflow the regex stack nor take quadratic time: separators that
cannot continue a match are first replaced by characters that end it, one for
one, so positions stay.  Positions are summed up in stretches of about the
root of the number of matches.

Defined results: null and empty texts have no spans; repeated rows give
repeated results and count once as a document; a null doc_id is an id like
any other; spans of different kinds may overlap.  An empty table gives an
empty result.  Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, of_row, quoted, sha, table, text_hash

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, TERM = 4, 5
#: Words before and after an entity that are near it.
WINDOW = 5
DISCLOSURE, PRIOR = 0.8, 0.5
#: Rows of (term) or (entity, term) that are looked up by broadcast, at most.
BROADCAST_TERMS = 500_000
#: Entities with more terms near them are looked up by their documents' words.
POPULAR = 1000

WORD, NOT_WORD = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
SPAN = "struct<kind:int,start:int,stop:int,value:string>"
FOUND = "struct<start:int,stop:int,value:string,before:string,after:string>"


def matches(text: Column, pattern: str, near: bool = False) -> Column:
    """Leftmost non-overlapping matches: array of FOUND, in code points from
    0.  They lie between the pieces of a split; ``near``: with the WINDOW words
    at the end of the piece before and at the start of the piece after."""
    tail = rf"(?:(?<!{WORD}){WORD}++{NOT_WORD}*+){{0,{WINDOW}}}\z"
    lead = rf"\A(?:{NOT_WORD}*+{WORD}++){{0,{WINDOW}}}"
    cut_ = (lambda gap, p: F.regexp_extract(gap, p, 0)) if near else (lambda gap, p: F.lit(None).cast("string"))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.char_length(g).alias("gap"), cut_(g, tail).alias("tail"), cut_(g, lead).alias("lead")))
    both = F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    # a lambda's argument is evaluated once, an expression at each use
    return F.get(F.transform(F.array(both), _placed), F.lit(0))


def _placed(both: Column) -> Column:
    gaps, values = both["gaps"], both["values"]
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(values))).cast("int"))
    none = F.array().cast(f"array<{FOUND}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, i: Column) -> Column:
        gap, value = F.get(gaps, i), F.get(values, i)
        begin = acc["at"] + gap["gap"]
        stop = begin + F.char_length(value)
        one = F.array(F.struct(begin.alias("start"), stop.alias("stop"), value.alias("value"), gap["tail"].alias("before"), F.get(gaps, i + 1)["lead"].alias("after")))
        return F.struct(stop.alias("at"), F.concat(acc["out"], one).alias("out"))

    def stretch(first: Column) -> Column:
        return F.aggregate(F.sequence(first, F.least(first + size, F.size(values)) - 1), start, step)

    def chain(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["stop"] + acc["at"]).alias("stop"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), size), stretch)
    return F.when(F.size(values) > 0, F.aggregate(chunks, start, chain, lambda acc: acc["out"])).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    d = _digits(x)
    n = F.char_length(d)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(v)

    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


#: Stands for a dot that ends a domain; in texts it counts as a space.
DOT = "\ue000"


def found_spans(text: Column, near: bool = False) -> list[Column]:
    """For each kind but ``term`` the array of FOUND."""
    local, domain, octet = f"[A-Za-z0-9._%+{DOT}-]", "[A-Za-z0-9-]", "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    dots = F.regexp_replace(F.translate(text, DOT, " "), rf"\.(?!{domain})", DOT)
    runs = F.regexp_replace(text, r"[\x20-](?![0-9])", "_")
    kinds = [
        (F.contains(text, F.lit("@")), dots, rf"(?:(?<!{local})|\G){local}++@{domain}++\.[A-Za-z0-9.-]++", None),
        (text.rlike(r"[0-9]\.[0-9]"), text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m["value"].rlike(rf"\A{octet}\.{octet}\.{octet}\.{octet}\z")),
        (text.rlike(r"[0-9][0-9\x20-]{11}"), runs, r"[0-9][0-9\x20-]{12,}+", lambda m: luhn(m["value"])),
        (F.contains(text, F.lit("+")), text, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.char_length(_digits(m["value"])).between(9, 15)),
        (text.rlike(r"[0-9A-Za-z_-]{24}"), text, r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{24,}+", lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")),
    ]
    none = F.array().cast(f"array<{FOUND}>")
    out = []
    for when, prepared, pattern, good in kinds:
        found = F.when(when, matches(prepared, pattern, near)).otherwise(none)
        out.append(F.filter(found, good) if good else found)
    return out


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by kind, then start."""
    return _spans([F.expr("array()").cast(f"array<{FOUND}>") if k >= BASE else f for k, f in enumerate(found_spans(text))])


def _spans(found: list[Column]) -> Column:
    named = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value"))
    return F.concat(*[F.transform(f, named(k)) for k, f in enumerate(found)])


def _near(found: list[Column]) -> Column:
    """(value, terms) of each entity."""
    terms = lambda text: F.filter(F.transform(F.split(text, f"{NOT_WORD}+"), F.lower), lambda w: F.char_length(w) >= 2)
    one = lambda m: F.struct(F.replace(m["value"], F.lit(DOT), F.lit(".")).alias("value"), F.concat(terms(m["before"]), terms(m["after"])).alias("terms"))
    return F.concat(*[F.transform(f, one) for f in found])


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def find_spans(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text_hash (with doc_id the row's key) and spans of each row:
    base kinds first, then secrets, then the terms that disclose an entity."""
    text = F.coalesce("text", F.lit(""))
    given = docs.select("doc_id", text.alias("text"), text_hash().alias("text_hash"))
    kinds = [f"f{k}" for k in range(TERM)]
    found = given.select("doc_id", "text_hash", "text", *[f.alias(k) for k, f in zip(kinds, found_spans(F.col("text"), near=True))])
    columns = [F.col(k) for k in kinds]
    found = found.select("doc_id", "text_hash", "text", _spans(columns).alias("base"), _near(columns).alias("near"))
    holds = F.size("base") > 0
    found = cut(found.select("doc_id", "text_hash", "base", F.when(holds, F.col("near")).alias("near"), F.when(holds, F.col("text")).alias("text")))

    row = ["doc_id", "text_hash"]
    each = found.filter(holds).select(*row, F.explode("near").alias("n")).select(*row, "n.value", "n.terms")
    entities = each.select(*row, "value").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("ne"))
    close = each.select(*row, "value", F.explode("terms").alias("term")).distinct().groupBy("value", "term").agg(F.count(F.lit(1)).alias("close"))
    pairs = cut(close.join(entities, "value"))

    # documents of each term, and documents that hold a term and its entity
    split = F.array_distinct(F.filter(F.transform(F.split("text", f"{NOT_WORD}+"), F.lower), lambda w: F.char_length(w) >= 2))
    wanted = _broadcast_if_small(cut(pairs.select("term").distinct()))
    counts = given.select(*row, F.explode(split).alias("term")).join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("nt"))
    words = found.filter(holds).select(*row, F.explode(split).alias("term")).distinct()
    # an entity of many different documents has terms from all of them: there a
    # document's own words are looked up, elsewhere the entity's terms
    popular = _broadcast_if_small(cut(pairs.groupBy("value").agg(F.count(F.lit(1)).alias("terms")).filter(F.col("terms") > POPULAR).select("value")))
    mentions = each.select(*row, "value").distinct()

    def held(terms: DataFrame) -> DataFrame:
        """row, value and term of the given terms of entities (value, term)
        that a document holds with the entity."""
        terms = _broadcast_if_small(terms)
        few = mentions.join(popular, "value", "left_anti").join(terms, "value").join(words, [*row, "term"])
        many = mentions.join(popular, "value", "left_semi").join(words, row).join(terms, ["value", "term"], "left_semi")
        return few.select(*row, "value", "term").unionByName(many.select(*row, "value", "term"))

    both = held(pairs.select("value", "term")).groupBy("value", "term").agg(F.count(F.lit(1)).alias("nte"))

    n = F.lit(float(found.count()))
    seen = F.greatest("nte", "close")
    share = F.log(seen * n / (F.greatest("nt", seen) * F.col("ne"))) / F.log(n / F.col("ne"))
    trust = (seen + F.col("close")) / (seen + F.col("close") + PRIOR)
    scored = pairs.join(counts, "term").join(both, ["value", "term"])
    telling = cut(scored.filter((F.col("ne") < n) & (share * trust >= disclosure)).select("value", "term"))

    in_doc = held(telling).select(*row, "term").distinct()
    places = found.filter(holds).select(*row, F.explode(matches(F.col("text"), f"{WORD}++")).alias("m")).select(*row, F.lower("m.value").alias("term"), "m.start", "m.stop")
    marks = places.join(in_doc, [*row, "term"]).groupBy(*row).agg(F.array_sort(F.collect_set(F.struct(F.lit(TERM).alias("kind"), "start", "stop", F.col("term").alias("value")))).alias("more"))
    marks = marks.toDF("i", "t", "more")
    none = F.array().cast(f"array<{SPAN}>")
    joined = found.join(marks, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")), "left")
    return joined.select(*row, F.concat(F.col("base").cast(f"array<{SPAN}>"), F.coalesce(F.col("more").cast(f"array<{SPAN}>"), none)).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with entities generalised to their kind and terms removed.
    ``spans``: sorted by start, the longer first; of overlapping ones, the
    first is replaced and the rest of the others removed."""
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:TERM]], F.lit(""))
    # furthest stop before each span, in stretches like matches()
    stops = F.transform(spans, lambda s: s["stop"])
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(spans))).cast("int"))
    chunks = F.sequence(F.lit(0), F.greatest(F.size(spans) - 1, F.lit(0)), size)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def piece(acc: Column, i: Column) -> Column:
        s, at = F.get(spans, i), F.greatest(acc["at"], F.lit(0))
        fresh = s["start"] >= at
        new = F.when(fresh, F.concat(F.substring(text, at + 1, s["start"] - at), F.get(label, s["kind"]))).otherwise("")
        return F.struct(F.greatest(at, s["stop"]).alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))

    def stretch(acc: Column, first: Column) -> Column:
        inner = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        done = F.aggregate(F.sequence(first, F.least(first + size, F.size(stops)) - 1), inner, piece)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(done["out"], ""))).alias("out"))

    done = F.aggregate(chunks, start, stretch, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with ``text`` sanitised; its columns stay."""
    (name,) = free(docs, "spans")
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    spans = find_spans(docs, disclosure).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", order.alias(name))
    return of_row(docs, spans, "left").withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col(name)))).select(*quoted(docs))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return found.select("doc_id", *[of(k) for k in range(BASE)], sha(_joined(base)).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), of(4), of(TERM), F.size("spans").cast("long").alias("n_spans"))
