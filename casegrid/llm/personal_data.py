"""Personal data in texts: fixed kinds by pattern, and further identifiers by bootstrapped contexts.

The base kinds (email, ip, card, phone) are found in every whole text by one regular expression each, leftmost and
non-overlapping; matches that fail their check are dropped. They seed the contexts: the word before, the two words
before, the word after, and the words on both sides of a match are lexical patterns. Other tokens with digits are
open instances. Patterns and instances form a graph, scored in rounds until a round accepts no pattern and finds no
instance more: a pattern's confidence for a kind is the mean score of the distinct instances it meets, and an open
instance's score is the mean confidence of its backed patterns, those not accepted counting 0. Instances that reach
``confidence`` are found and from then on count as seeds do. Patterns are backed by ``support`` seeds or found
instances and accepted at ``confidence``; both stay, so rounds come to an end. The open instances that accepted
patterns meet become spans of that kind. Base spans always stay.

Only Spark functions are used. Texts are scanned once, in place; what goes through shuffles are matches with their
contexts, and the graph holds each pattern and instance once, so a frequent context or identifier costs one row.

Null or empty text: no spans. Null doc_id is a value like others. Repeated rows get the same spans. Offsets are code
points, end exclusive. Ties between kinds for one token: higher confidence, then the kind listed first. An empty
table gives no rows. Other columns are kept by ``mask``, whatever their names; ``find`` reads doc_id and text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.llm.common import neutral, require
from casegrid.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
OPEN = "open"
_LOCAL = "A-Za-z0-9._%+-"
#: The patterns of the kinds. A run is tried once, from its start or where the last match ended, and repeats do not
#: give back what they took: the matches are the same, in time linear in the text.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    OPEN: r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+",
}
#: Context that is looked at on either side of a match, in code points.
CONTEXT = 80
SPAN = "struct<start:int,end:int,match:string,before:string,after:string>"


#: Lengths added up in one run. What a fold carries is copied at every step, so runs are short and carry numbers only.
RUN = 256


def running_ends(lengths: Column) -> Column:
    """Running sums of an array of lengths: totals of runs first, then the sums inside each run.

    ``lengths`` should be a column of its own: it is read once for every run.
    """
    add = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda r: F.slice(lengths, r * RUN + 1, F.lit(RUN)))
    totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda acc, n: acc + n))
    starts = F.aggregate(totals, F.array(F.lit(0)), add)
    none = F.array().cast("array<int>")
    inside = F.zip_with(runs, starts, lambda run, s: F.slice(F.aggregate(F.coalesce(run, none), F.array(s), add), F.lit(2), F.lit(RUN)))
    return F.flatten(inside)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + value(i))
    return total % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The check that a match of the kind must pass."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    if kind == OPEN:
        return (n >= 4) & F.length(match).between(5, 200)
    return F.lit(True)


def _check(kind: str):
    return lambda s: passes(kind, s["match"])


def with_matches(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Adds a column per kind with the spans that pass; reads the column ``text``.

    The stretches between matches and the matches themselves give the places: a match ends at the running sum of both.
    """
    names = df.columns
    gaps, hits = [], []
    for kind in kinds:
        there = F.col("text").rlike(PATTERNS[kind])
        gaps.append(F.when(there, F.split("text", PATTERNS[kind], -1)).alias(f"_gaps_{kind}"))
        hits.append(F.when(there, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), 0)).alias(f"_hits_{kind}"))
    df = df.select(*names, *gaps, *hits)
    both = lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0))
    df = df.select("*", *[F.zip_with(f"_gaps_{k}", f"_hits_{k}", both).alias(f"_lengths_{k}") for k in kinds])
    df = df.select("*", *[running_ends(F.col(f"_lengths_{k}")).alias(f"_ends_{k}") for k in kinds])
    found = [F.coalesce(F.filter(_spans(k), _check(k)), F.array().cast(f"array<{SPAN}>")).alias(k) for k in kinds]
    return df.select(*names, *found)


def _spans(kind: str) -> Column:
    """The matches of a kind with their places and contexts; the stretch after the last match has no match."""
    gaps, hits = F.col(f"_gaps_{kind}"), F.col(f"_hits_{kind}")
    n = F.size(hits)
    around = F.zip_with(
        F.slice(gaps, F.lit(1), n),
        F.slice(gaps, F.lit(2), n),
        lambda g, a: F.struct(F.substring(g, -CONTEXT, CONTEXT).alias("before"), F.substring(a, 1, CONTEXT).alias("after")),
    )
    placed = F.zip_with(hits, F.slice(f"_ends_{kind}", F.lit(1), n), lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("match")))
    span = lambda p, c: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["match"].alias("match"), c["before"].alias("before"), c["after"].alias("after"))
    return F.zip_with(placed, around, span)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the spans per kind of every row, written once: all that later steps need of the texts."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = with_matches(rows.select("doc_id", text_key(F.col("text")).alias("text_key"), "text"), (*KINDS, OPEN))
    return cut_lineage(found.select("doc_id", "text_key", *KINDS, OPEN))


def text_key(text: Column) -> Column:
    return F.concat_ws(":", F.length(text), F.xxhash64(text), F.crc32(text))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """One row per match: kind, place, instance and contexts. Open tokens that touch a base span are left out."""
    parts = [scanned.select("doc_id", "text_key", F.lit(k).alias("kind"), F.inline(k)) for k in (*KINDS, OPEN)]
    rows = reduce(DataFrame.unionByName, parts).distinct()
    by_place = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    base = F.col("kind") != OPEN
    earlier = F.max(F.when(base, F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = F.min(F.when(base, F.col("start"))).over(by_place.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = rows.withColumn("earlier", earlier).withColumn("later", later)
    free = (F.coalesce(F.col("earlier") <= F.col("start"), F.lit(True))) & (F.coalesce(F.col("later") >= F.col("end"), F.lit(True)))
    return placed.filter(base | free).drop("earlier", "later")


def _word(text: Column, pattern: str, group: int) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(text, pattern, group), r"[^\p{L}]+", ""))


def contexts(before: Column, after: Column) -> Column:
    """The lexical patterns around a match, as an array."""
    last = _word(before, r"(\S+)\s*\z", 1)
    second = _word(before, r"(\S+)\s+\S+\s*\z", 1)
    next_ = _word(after, r"\A\s*(\S+)", 1)
    made = F.array(
        F.when(last != "", F.concat(F.lit("b "), last)),
        F.when((last != "") & (second != ""), F.concat(F.lit("bb "), second, F.lit(" "), last)),
        F.when(next_ != "", F.concat(F.lit("a "), next_)),
        F.when((last != "") & (next_ != ""), F.concat(F.lit("ba "), last, F.lit(" _ "), next_)),
    )
    return F.array_compact(made)


def discovered(scanned: DataFrame, rounds: int | None = None, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """doc_id, text_key, kind, start, end of the spans that accepted patterns add; ``rounds`` may end the search early."""
    met = cut_lineage(
        _occurrences(scanned).select("doc_id", "text_key", "kind", "start", "end", F.xxhash64("match").alias("instance"), F.explode(contexts(F.col("before"), F.col("after"))).alias("pattern"))
    )
    edges = cut_lineage(met.groupBy("pattern", "instance").agg(F.min(F.when(F.col("kind") != OPEN, F.col("kind"))).alias("seed")))
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    seed_links = edges.filter("seed is not null").select("pattern", "instance", F.col("seed").alias("kind"))
    seeds = seed_links.select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    links, scores, accepted, found = seed_links, seeds, None, None
    counted, done = (0, 0), 0
    while rounds is None or done < rounds:
        # patterns that neither seeds nor found instances back cannot be accepted in this round: only the others are scored
        backed = links.groupBy("pattern", "kind").agg(F.count("*").alias("backers")).filter(F.col("backers") >= support)
        backed = cut_lineage(backed.select("pattern", "kind").join(size, "pattern"))
        live = cut_lineage(edges.join(backed.select("pattern").distinct(), "pattern", "left_semi"))
        mass = live.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        rated = backed.join(mass, ["pattern", "kind"]).select("pattern", "kind", (F.col("mass") / F.col("size")).alias("confidence"))
        more = rated.filter(F.col("confidence") >= confidence)
        accepted = cut_lineage(more if accepted is None else accepted.unionByName(more.join(accepted, ["pattern", "kind"], "left_anti")))
        done += 1
        n_accepted = accepted.count()
        if not n_accepted or done == rounds:
            break
        rates = backed.select("pattern", "kind").join(accepted, ["pattern", "kind"], "left")
        reached = live.filter("seed is null").select("pattern", "instance").join(rates, "pattern").groupBy("instance", "kind")
        reached = cut_lineage(reached.agg((F.sum(F.coalesce("confidence", F.lit(0.0))) / F.count("*")).alias("score")).filter("score > 0"))
        high = reached.filter(F.col("score") >= confidence).select("instance", "kind").join(seeds, ["instance", "kind"], "left_anti")
        found = cut_lineage(high if found is None else found.unionByName(high).distinct())
        now = (n_accepted, found.count())
        if now == counted:
            break
        counted = now
        links = cut_lineage(seed_links.unionByName(edges.join(found, "instance").select("pattern", "instance", "kind")).distinct())
        sure = seeds.unionByName(found.withColumn("score", F.lit(1.0)))
        scores = cut_lineage(sure.unionByName(reached).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    hits = met.filter(F.col("kind") == OPEN).drop("kind").join(accepted, "pattern")
    order = F.struct("confidence", (-_rank(F.col("kind"))).alias("place"), "kind")
    best = hits.groupBy("doc_id", "text_key", "start", "end").agg(F.max(order).alias("best"))
    return best.select("doc_id", "text_key", F.col("best.kind").alias("kind"), "start", "end")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def _added(spans: DataFrame) -> DataFrame:
    """The added spans of each text as one array of (rank, kind, start, end)."""
    span = F.struct(_rank(F.col("kind")).alias("rank"), "kind", "start", "end")
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list(span).alias("added"))


def _tagged(i: int, kind: str):
    return lambda s: F.struct(F.lit(i + 1).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _base() -> Column:
    """Base spans of a scanned row as an array of (rank, kind, start, end), by kind and start."""
    return F.concat(*[F.transform(k, _tagged(i, k)) for i, k in enumerate(KINDS)])


def find(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, base and spans of every row: arrays of (rank, kind, start, end), by kind as listed, then by start."""
    require(docs, "doc_id", "text")
    scanned = scan(docs)
    added = cut_lineage(_added(discovered(scanned, **settings))).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    rows = scanned.select("doc_id", "text_key", _base().alias("base"))
    both = rows.join(added, rows.doc_id.eqNullSafe(added["_doc"]) & (rows.text_key == added["_key"]), "left")
    none = F.array().cast("array<struct<rank:int,kind:string,start:int,end:int>>")
    spans = F.array_sort(F.concat("base", F.coalesce("added", none)))
    kind = docs.schema["doc_id"].dataType
    return both.select(F.col("doc_id").cast(kind).alias("doc_id"), "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans, their digest and all spans as text."""
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, and what overlaps it, replaced by its kind in brackets."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        clear = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(clear, more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(by_place, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def mask(docs: DataFrame, **settings) -> DataFrame:
    """The documents with personal data masked in ``text``, and ``n_chars``, where there is one, brought up to date."""
    require(docs, "doc_id", "text")
    added = cut_lineage(_added(discovered(scan(docs), **settings))).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    plain, names = neutral(docs, "doc_id", "text", "n_chars")
    rows = with_matches(plain, KINDS).withColumn("_base", _base())
    both = rows.join(added, rows.doc_id.cast("string").eqNullSafe(added["_doc"]) & (text_key(F.coalesce(rows.text, F.lit(""))) == added["_key"]), "left")
    none = F.array().cast("array<struct<rank:int,kind:string,start:int,end:int>>")
    spans = F.concat("_base", F.coalesce("added", none))
    text = F.when(F.size(spans) > 0, masked(F.col("text"), spans)).otherwise(F.col("text"))
    out = both.withColumn("_text", text)
    size = F.length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    chosen = {"text": F.col("_text").alias("text")} | ({"n_chars": size.alias("n_chars")} if size is not None else {})
    return out.select(*[chosen.get(c, F.col(c)) for c in plain.columns]).toDF(*names)
