"""Personal data by fixed patterns and by contexts learned from them; DataFrame functions only.

Base spans come from fixed patterns (email, ip, card, phone) whose matches are checked (octets, Luhn digits, number of
digits) and dropped without a second try if they fail. They seed a bootstrap. Each seed and each candidate (addresses with
@, [at], (at) or at ... dot, runs of digits with blanks and signs, other words with a digit; nothing that touches a base
span) has lexical patterns: the one and two words before it and behind it, the words on either side together, and a label
that ends with a colon or an equals sign. In patterns words are in lower case, runs of digits are 0, base spans are #,
and the start or end of a line is a word of its own. Windows of `REACH` characters are cut alike for both.

Patterns and strings make a graph, and scores go back and forth until no string is new: a pattern's score for a kind is
the share of known strings among the distinct strings in it that have the kind's rough shape (at least `SEEDS` known ones
and `TRUST`); a string's score is one minus the product of (1 - score) over its patterns; a string that reaches `SURE`
is known from then on. At last each such string is a span wherever it stands in a trusted pattern of its kind. Strings are
grouped before anything is joined, so a pattern that is everywhere is one counted row a string, not a group.

Expressions are written with possessive or bounded repeats and begin only where a run begins (or the last match ended);
that changes no match and keeps very long runs linear and the regex engine's stack flat. Places are running sums by blocks,
and texts are cut by blocks of characters, so the time stays in proportion to the text with any number of matches.

Defined results: null and empty texts have no spans. Rows that repeat a doc_id are told apart by a hash of their text;
rows equal in both get equal results. An empty table gives an empty one. Further columns may have any names. Places are in
code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.plans.staging import drop, stage

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Without such a character a text has no match of the kind.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Candidates for contexts to find, and what a text with one holds.
CANDIDATE = (
    r"(?<![^\s:=(\[\"'<,;|])(?:"
    r"[^\s@\x00\[(]{1,64}+(?:@| ?[\[(]at[\])] ?)[^\s@\x00]*[A-Za-z0-9]"
    r"|[A-Za-z0-9._%+-]{1,64}+ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++"
    r"|[+(]?[0-9][0-9().\-/ ]{4,24}[0-9](?![A-Za-z0-9])"
    r"|(?=[^\s0-9@\x00]*+[0-9@])[^\s\x00]*[A-Za-z0-9])"
)
CANDIDATE_HINT = r"[0-9@]|[\[(]at[\])]| dot "
#: Rough shapes that a found string must have, by kind.
SHAPES = {
    "email": r"^[^\s@]{1,64}(@| ?[\[(]at[\])] ?)[^\s@]{2,}$|^\S+ at \S+( dot \S+)+$",
    "ip": r"^[0-9A-Fa-f]{1,4}([.:]{1,2}[0-9A-Fa-f]{1,4}){3,7}$",
    "card": r"^[0-9]([ -]?[0-9]){11,18}$",
    "phone": r"^(?=([^0-9]*[0-9]){7,15}[^0-9]*$)[+(]?[0-9][0-9().\-/ ]{4,24}[0-9]$",
}
#: Known strings that a pattern needs, least score of a pattern and of a string, characters of context on a side.
SEEDS, TRUST, SURE, REACH = 3, 0.5, 0.9, 64
#: Values of a running sum's block, and characters of a text's block.
RUN, CUT = 128, 512
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op, zero: Column) -> Column:
    """op over all values up to each one; arrays of running values grow within blocks only."""

    def within(start: Column, part: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["last"], x).alias("last"), F.concat(acc["out"], F.array(op(acc["last"], x))).alias("out"))
        return F.aggregate(part, F.struct(start.alias("last"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def of(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda k: F.slice(v, k * RUN + 1, RUN))

        def joined(p: Column) -> Column:
            ends = within(zero, F.transform(p, lambda part: F.aggregate(part, zero, op)))
            return F.flatten(F.zip_with(p, F.concat(F.array(zero), F.slice(ends, F.lit(1), F.size(p) - 1)), lambda part, start: within(start, part)))

        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(_let(parts, joined))

    return _let(values, of)


def placed(text: Column, pattern: str) -> Column:
    """Matches of a pattern: start, end and text of each."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def of(both: Column) -> Column:
        n = F.size(both["found"])
        steps = F.zip_with(both["found"], F.slice(both["gaps"], F.lit(1), n), lambda m, gap: F.length(m) + F.length(gap))
        ends = running(steps, lambda a, x: a + x, F.lit(0))
        return F.zip_with(both["found"], ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text")))

    return _let(F.struct(found.alias("found"), gaps.alias("gaps")), of)


def blocks(text: Column) -> Column:
    """The text in blocks of CUT characters, so that a part of it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of a text in blocks; places outside it count as its start and end."""
    low = F.greatest(start, F.lit(0))
    first = F.floor(low / CUT).cast("int")
    block = lambda k: F.coalesce(F.get(cut, k), F.lit(""))
    # Short parts lie in two blocks at most; long ones are as few as there are blocks.
    some = F.when(end - low <= CUT, F.concat(block(first), block(first + 1))).otherwise(F.array_join(F.slice(cut, first + 1, F.greatest(F.floor(end / CUT).cast("int") - first + 1, F.lit(0))), ""))
    return F.when(end > low, F.substring(some, low - first * CUT + 1, end - low)).otherwise("")


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with each span exchanged for by(span, its characters that no span before it covers)."""

    def of(x: Column) -> Column:
        order = F.array_sort(F.transform(x["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

        def rebuilt(y: Column) -> Column:
            covered = running(F.transform(y["order"], lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))

            def with_covered(z: Column) -> Column:
                before = F.concat(F.array(F.lit(0)), F.slice(z, F.lit(1), F.size(z) - 1))
                pieces = F.zip_with(y["order"], before, lambda s, b: F.concat(between(y["cut"], b, s["start"]), by(s, F.greatest(s["end"] - F.greatest(s["start"], b), F.lit(0)))))
                return F.concat(F.array_join(pieces, ""), between(y["cut"], F.element_at(z, -1), F.length(x["text"])))

            return _let(covered, with_covered)

        return _let(F.struct(order.alias("order"), blocks(x["text"]).alias("cut")), rebuilt)

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.struct(text.alias("text"), spans.alias("spans")), of))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(x)), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * (1 + i % 2))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _octet(x: Column) -> Column:
    plain = F.regexp_replace(x, "^0+", "")
    return (F.length(plain) <= 3) & (F.concat(F.lit("0"), F.left(plain, F.lit(3))).cast("int") <= 255)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), _octet)
    if kind == "card":
        n = F.length(_digits(x))
        return F.when(F.length(x) < 16, False).when(n.between(16, 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Checked matches of a kind."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    found = F.filter(placed(text, PATTERNS[kind]), lambda m: _valid(kind, m["text"]))
    hint = HINTS[kind] or "[0-9]"
    return F.when(F.regexp_like(text, F.lit("[" + hint + "]" if len(hint) == 1 else hint)), found).otherwise(none)


def _spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _patterns(left: Column, right: Column) -> Column:
    """Hashes of the lexical patterns around a place."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"\x00+", "#"), "[0-9]+", "0")
    before = F.concat(F.lit("^ ^ "), F.regexp_extract(plain(left), r"([^\n]*)$", 1))
    after = F.concat(F.regexp_extract(plain(right), r"^([^\n]*)", 1), F.lit(" $ $"))

    def words(x: Column) -> Column:
        return F.struct(
            F.regexp_extract(x["before"], r"(\S+)\s*$", 1).alias("l1"), F.regexp_extract(x["before"], r"(\S+\s+\S+)\s*$", 1).alias("l2"),
            F.regexp_extract(x["after"], r"^\s*(\S+)", 1).alias("r1"), F.regexp_extract(x["after"], r"^\s*(\S+\s+\S+)", 1).alias("r2"),
        )

    def hashes(w: Column) -> Column:
        one = lambda x: F.regexp_replace(x, r"\s+", " ")
        label = F.when(F.regexp_like(w["l1"], F.lit("[:=]$")), w["l1"]).otherwise(F.concat(w["l1"], F.lit(" "), w["r1"]))
        named = (("before", w["l1"]), ("two before", one(w["l2"])), ("behind", w["r1"]), ("two behind", one(w["r2"])), ("around", F.concat(w["l1"], F.lit(" "), w["r1"])), ("label", label))
        return F.array(*[F.xxhash64(F.lit(name), x) for name, x in named])

    return _let(_let(F.struct(before.alias("before"), after.alias("after")), words), hashes)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key, the base spans, and `met`: base matches and candidates with their patterns."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "key", "text", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    own = lambda k: F.transform(k, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))
    rows = rows.select("doc_id", "key", "text", F.concat(*[own(k) for k in KINDS]).alias("seeds"))
    hidden = replaced(F.col("text"), F.col("seeds"), lambda s, n: F.repeat(F.lit("\0"), n))
    rows = rows.withColumn("hidden", F.when((F.size("seeds") > 0) | F.regexp_like("text", F.lit(CANDIDATE_HINT)), hidden))
    free = F.transform(placed(F.col("hidden"), CANDIDATE), lambda m: F.struct(F.lit(None).cast("string").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))
    items = F.concat("seeds", F.when(F.regexp_like("hidden", F.lit(CANDIDATE_HINT)), free).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")))

    def described(cut: Column) -> Column:
        def of(m: Column) -> Column:
            fits = [F.when(m["kind"] == k, F.lit(1 << i)).when(m["kind"].isNull() & F.regexp_like(m["text"], F.lit(SHAPES[k])), F.lit(1 << i)).otherwise(0) for i, k in enumerate(KINDS)]
            patterns = _patterns(between(cut, m["start"] - REACH, m["start"]), between(cut, m["end"], m["end"] + REACH))
            return F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.xxhash64(F.lower(m["text"])).alias("string"), sum(fits[1:], fits[0]).alias("fits"), patterns.alias("patterns"))

        return F.filter(F.transform(items, of), lambda m: m["fits"] > 0)

    met = _let(blocks(F.col("hidden")), described)
    base = F.transform("seeds", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", "key", base.alias("base"), F.when(F.col("hidden").isNotNull(), met).alias("met"))


def found_spans(scanned: DataFrame) -> DataFrame:
    """doc_id, key and the spans that contexts find, for rows that have any."""
    each = scanned.select("doc_id", "key", F.explode("met").alias("m")).select("doc_id", "key", "m.kind", "m.start", "m.end", "m.string", "m.fits", F.explode("m.patterns").alias("pattern"))
    edges = stage(each.groupBy("pattern", "string").agg(F.max("kind").alias("seed"), F.max("fits").alias("fits")), "pii-edges")
    fits = lambda i: F.col("fits").bitwiseAND(F.lit(1 << i)) > 0
    known, strings, n_known = edges.withColumn("kind", F.col("seed")), None, -1
    while True:
        counts = known.groupBy("pattern").agg(*[F.struct(F.count_if(F.col("kind") == k).alias("known"), F.count_if(fits(i)).alias("n")).alias(k) for i, k in enumerate(KINDS)])
        of = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), F.lit(1 << i).alias("bit"), F.col(k)["known"].alias("known"), (F.col(k)["known"] / (F.col(k)["n"] + 0.5)).alias("score")) for i, k in enumerate(KINDS)]))
        trusted = stage(counts.select("pattern", of.alias("t")).select("pattern", "t.*").where((F.col("known") >= SEEDS) & (F.col("score") >= TRUST)).drop("known"), "pii-trusted")
        met = edges.where("seed IS NULL").join(trusted, "pattern").where("fits & bit > 0")
        scores = met.groupBy("string", "of").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score")).where(F.col("score") >= SURE)
        best = scores.groupBy("string").agg(F.max(F.struct("score", "of"))["of"].alias("found"))
        # What was known stays known, so the rounds end.
        both = best if strings is None else strings.unionByName(best.join(strings, "string", "left_anti"))
        before, strings = strings, stage(both, "pii-strings")
        n_before, n_known = n_known, strings.count()
        if before is not None:
            drop(before)
        if n_known in (0, n_before):
            break
        old, known = known, stage(edges.join(strings, "string", "left").select("pattern", "string", "fits", F.coalesce("seed", "found").alias("kind")), "pii-known")
        drop(old, trusted)
    drop(edges, known)
    sure = each.where("kind IS NULL").join(strings, "string").join(trusted.select("pattern", F.col("of").alias("found")), ["pattern", "found"])
    return sure.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct(F.col("found").alias("kind"), "start", "end"))).alias("found"))


def spans(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, key (hash of the text), base and all spans, by kind as listed, then start."""
    scanned = stage(scan(docs), "pii-scan")
    found = found_spans(scanned)
    both = scanned.join(found.select(F.col("doc_id").alias("id"), F.col("key").alias("of"), "found"), scanned.doc_id.eqNullSafe(F.col("id")) & (scanned.key == F.col("of")), "left")
    rank = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(
        F.transform(F.concat("base", F.coalesce("found", F.array().cast(SPAN))), lambda s: F.struct(F.array_position(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return both.select("doc_id", "key", "base", F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, the hash of their spans, and all spans."""
    own = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans(docs).select("doc_id", *[own(k) for k in KINDS], F.sha2(_spelled(F.col("base")), 256).alias("base_sha256"), _spelled(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in square brackets; spans that overlap count as one."""
    found = spans(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("id"), "key", "spans").distinct()
    # The rows of docs stand in a struct, so that their columns may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(found, F.col("row.doc_id").eqNullSafe(found.id) & (F.xxhash64("row.text") == found.key), "left")
    text = replaced(F.col("row.text"), F.col("spans"), lambda s, n: F.when(s["end"] - s["start"] == n, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
    new = F.when(F.col("spans").isNotNull(), text).otherwise(F.col("row.text"))
    return met.select(*[new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
