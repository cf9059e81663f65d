"""Operator 8: personal data by pattern, and by information-theoretic disclosure, in built-in functions only.

Base entities are matched by pattern. Beyond them the corpus decides: a word near an entity is a
``term`` span if the word gives the entity away, that is if the entity stands near it on at least
half of all different lines that have the word (its pointwise information about the entity is then
within one bit of all there is). A value after a name, as in ``name = "value"``, is a ``secret`` span
if the name is followed by a new value almost every time, over the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import checkpoint_dir
from .quality_rules import let

# Runs are possessive and start only where a run starts or the last match ended (\G): no other
# start within a run can match if those can't, and long runs take linear time.
_PART = r"[0-9]++"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?:\G|(?<![0-9])){_PART}\.{_PART}\.{_PART}\.{_PART}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: A name, = or :, and a value of letters and digits.
SECRET = r"""(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9_]{1,31}+)[\x20\x09]{0,4}[=:][\x20\x09]{0,4}["']?([A-Za-z0-9_+/-]{20,})"""
MORE = ("term", "secret")  #: kinds that the method adds

MIN_CONTEXTS = 3  #: different lines in which a term and an entity meet; different values of a secret's name
DISCLOSURE = 0.5  #: share of a term's lines that hold the one entity: more gives it away
NEAR = 80  #: characters on either side of an entity in which a term is near it
BLOCK = 256
FEW = 1 << 18  #: rows of joined tables that are sent out whole


SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _span(kind: str, m: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    figures = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(figures, F.lit(0), lambda n, d: n + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(x)).between(16, 19), _luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def running(values: Column, step, zero: int = 0) -> Column:
    """For each of an array of ints ``step`` over all before it; in blocks, so that time is linear in practice."""
    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
    nested = F.struct(F.lit(zero).alias("at"), F.array().cast("array<array<int>>").alias("out"))

    def block(x: Column) -> Column:
        return F.aggregate(x, start, lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def of(a: Column) -> Column:
        last = F.greatest(F.ceil(F.size(a) / BLOCK).cast("int") - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: block(F.slice(a, i * BLOCK + 1, BLOCK)))
        add = lambda acc, b: F.struct(step(acc["at"], b["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(b["out"], lambda y: step(acc["at"], y)))).alias("out"))
        return F.flatten(F.aggregate(blocks, nested, add)["out"])

    return let(values, of)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """``start, end, value`` of every match, leftmost and without overlap, in code points; null if there is none.

    What lies between matches (``split``) and the matches (``regexp_extract_all``) come from the
    same search, so running sums of their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(f: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(running(F.zip_with(F.slice(gaps, 1, F.size(f)), f, lambda g, m: F.length(g) + F.length(m)), _sum), lambda before: spans(f, gaps, before)))

    def spans(f: Column, gaps: Column, before: Column) -> Column:
        start = lambda i: F.get(before, i) + F.length(F.get(gaps, i))
        return F.transform(f, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end"), m.alias("value")))

    return let(found, lambda f: F.when(F.size(f) > 0, placed(f)))


def base_spans(text: Column) -> Column:
    """Valid base matches as ``kind, start, end, value``, by kind and then start."""
    nothing = F.array().cast(SPANS)

    def of(kind: str, pattern: str) -> Column:
        # More digits in a row than a card has are one match, which is dropped.
        hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9](?:[ -]?[0-9]){15}")
        valid = F.filter(F.when(hint, matches(text, pattern)), lambda m: _valid(kind, m["value"]))
        return F.coalesce(F.transform(valid, lambda m: _span(kind, m)), nothing)

    return F.concat(*[of(*x) for x in PATTERNS.items()])


def _few(table: DataFrame) -> DataFrame:
    """A table to be joined by its key: sent out whole if counted to be small, else dealt."""
    return F.broadcast(table) if table.count() <= FEW else table.hint("merge")


def _located(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row, doc_id, spans``, and ``text`` where it has an entity or an assignment, in a checkpoint: texts are searched once."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), whole.alias("text"), base_spans(whole).alias("spans"))
    assigned = (F.contains("text", F.lit("=")) | F.contains("text", F.lit(":"))) & F.col("text").rlike(SECRET)
    return rows.select("row", "doc_id", "spans", F.when((F.size("spans") > 0) | assigned, F.col("text")).alias("text")).checkpoint()


def _spots(located: DataFrame) -> DataFrame:
    """Each entity where it stands: ``row, line_id, entity, before, after`` with the words around it on its line, and where those begin.

    No pattern goes across a line, so a line has the entities that the text has there.
    """
    lines = F.split("text", "\n")
    starts = running(F.transform(lines, lambda x: F.length(x) + 1), _sum)
    found = located.filter("size(spans) > 0").select("row", F.explode(F.arrays_zip(lines.alias("line"), starts.alias("at"))).alias("l"))
    found = found.select("row", F.col("l.line").alias("line"), F.col("l.at").alias("at"), F.array_sort(F.transform(base_spans(F.col("l.line")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))).alias("own"))
    line = F.col("line")

    def around(s: Column, i: Column) -> Column:
        low = F.greatest(F.coalesce(F.get(F.col("own"), i - 1)["end"], F.lit(0)), s["start"] - NEAR)
        high = F.least(F.coalesce(F.get(F.col("own"), i + 1)["start"], F.length(line)), s["end"] + NEAR)
        before = F.when(low < s["start"], F.substring(line, low + 1, s["start"] - low)).otherwise("")
        after = F.when(high > s["end"], F.substring(line, s["end"] + 1, high - s["end"])).otherwise("")
        # A word that the window cuts is none.
        cut = F.when(low == s["start"] - NEAR, F.regexp_replace(before, f"^{TERM}", "")).otherwise(before)
        kept = F.when(high == s["end"] + NEAR, F.regexp_replace(after, f"{TERM}$", "")).otherwise(after)
        return F.struct(s["value"].alias("entity"), cut.alias("before"), (s["start"] - F.length(cut)).alias("from"), kept.alias("after"), s["end"].alias("end"))

    spots = found.filter("size(own) > 0").select("row", F.md5("line").alias("line_id"), "at", F.explode(F.transform("own", around)).alias("s"))
    return spots.select("row", "line_id", F.col("s.entity").alias("entity"), "s.before", (F.col("at") + F.col("s.from")).alias("before_at"), "s.after", (F.col("at") + F.col("s.end")).alias("after_at"))


def _terms(text: Column) -> Column:
    """Lower-cased distinct terms."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def revealing_terms(spots: DataFrame, docs: DataFrame) -> DataFrame:
    """``term, entity`` pairs where the term gives the entity away, measured over the whole corpus.

    Equal lines count once on both sides, so copies and repeated notices add nothing. A term is
    revealing if it stands near the entity on at least ``MIN_CONTEXTS`` different lines, and these
    are at least ``DISCLOSURE`` of all different lines of the corpus that have the term.
    """
    contexts = spots.select("line_id", "entity", F.explode(_terms(F.concat("before", F.lit("\n"), "after"))).alias("term")).distinct()
    pairs = contexts.groupBy("term", "entity").agg(F.count("*").alias("together")).filter(F.col("together") >= MIN_CONTEXTS).checkpoint()
    if pairs.isEmpty():
        return pairs.select("term", "entity")
    wanted = _few(pairs.select("term").distinct())
    # Different lines are found first, so what is shuffled is each line once and not each of its terms; terms are then counted where their lines are.
    different = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''").distinct()
    words = different.select(F.explode(_terms(F.col("line"))).alias("term"))
    lines = words.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("lines"))
    return pairs.join(lines, "term").filter(F.col("together") >= DISCLOSURE * F.col("lines")).select("term", "entity").checkpoint()


def _term_spans(spots: DataFrame, given: DataFrame) -> DataFrame:
    """``row, span`` of the words near an entity that give it away."""
    known = given.groupBy("entity").agg(F.collect_set("term").alias("terms"))
    near = spots.join(_few(known), "entity")

    def of(side: str) -> Column:
        told = F.filter(matches(F.col(side), TERM), lambda m: F.array_contains("terms", F.lower(m["value"])))
        moved = F.transform(told, lambda m: F.struct(F.lit("term").alias("kind"), (m["start"] + F.col(f"{side}_at")).alias("start"), (m["end"] + F.col(f"{side}_at")).alias("end"), m["value"].alias("value")))
        return F.coalesce(moved, F.array().cast(SPANS))

    return near.select("row", F.explode(F.concat(of("before"), of("after"))).alias("span"))


def _secret_spans(located: DataFrame) -> DataFrame:
    """``row, span`` of values after names that over the whole corpus are followed by a new value almost every time."""
    held = located.filter(F.col("text").rlike(SECRET)).select("row", F.explode(matches(F.col("text"), SECRET)).alias("m"))
    name = F.lower(F.regexp_extract(F.col("m.value"), SECRET, 1))
    value = F.regexp_extract(F.col("m.value"), SECRET, 2)
    held = held.select("row", name.alias("name"), value.alias("value"), (F.col("m.end") - F.length(value)).alias("start"), F.col("m.end").alias("end"))
    held = held.filter(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).checkpoint()
    # The same name and value in copies count once; a name of which one value makes up much is no secret's.
    times = held.groupBy("name", "value").agg(F.count("*").alias("n"))
    names = times.groupBy("name").agg(F.count("*").alias("values")).filter(F.col("values") >= MIN_CONTEXTS)
    told = held.join(_few(names.select("name")), "name", "left_semi")
    return told.select("row", F.struct(F.lit("secret").alias("kind"), "start", "end", "value").alias("span"))


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``doc_id, spans``, and ``text`` where it has spans (null elsewhere).

    Spans are ``kind, start, end, value`` in code points: base kinds (emails, IP addresses, cards and
    phone numbers), then ``term`` and ``secret`` spans, each by start; those lie outside base spans.

    Nulls are empty texts; these have no spans. Repeated rows each get their own, copies make nothing
    revealing. Time is linear in a text's length, give or take a text of very many entities. An empty
    table gives no rows; other columns are ignored.
    """
    checkpoint_dir(docs.sparkSession)
    located = _located(docs, doc_id, text)
    spots = _spots(located)
    given = revealing_terms(spots, docs.select(F.col(text).alias("text")))
    more = _secret_spans(located)
    if not given.isEmpty():
        more = more.unionByName(_term_spans(spots, given))
    added = more.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("added")).checkpoint()
    out = located.join(_few(added), "row", "left")
    clear = F.filter("added", lambda a: ~F.exists("spans", lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"])))
    by_kind = F.concat(*[F.filter(clear, lambda a: a["kind"] == kind) for kind in MORE])  # noqa: B023
    spans = F.concat("spans", F.coalesce(by_kind, F.array().cast(SPANS)))
    out = out.select("row", "doc_id", spans.alias("spans"), "text")
    return out.select("doc_id", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def generalised(text: Column, spans: Column) -> Column:
    """``text`` with base spans and secrets as ``[kind]`` and terms removed; of overlapping spans the first one counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def piece(s: Column, seen: Column) -> Column:
        between = F.when(s["start"] > seen, F.substring(text, seen + 1, s["start"] - seen)).otherwise("")
        label = F.when((s["start"] < seen) | (s["kind"] == "term"), "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.concat(between, label)

    def cut(x: Column) -> Column:
        ends = F.transform(x, lambda s: s["end"])
        rest = F.substring(text, F.coalesce(F.array_max(ends), F.lit(0)) + 1, F.length(text))
        return let(running(ends, F.greatest), lambda seen: F.concat(F.array_join(F.transform(x, lambda s, i: piece(s, F.get(seen, i))), ""), rest))

    return let(ordered, cut)


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` of the rows with personal data, generalised (``generalised``); other rows need no change."""
    found = find_spans(docs, doc_id, text).filter("text IS NOT NULL")
    return found.select("doc_id", generalised(F.col("text"), F.col("spans")).alias("text"))
