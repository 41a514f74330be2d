r"""Personal data, and terms that give it away.

Base spans come from four patterns (email, ip, card, phone), leftmost and
non-overlapping per kind, with checks of their parts.  The patterns are written
so that Java's matcher needs no backtracking: a run of name characters is tried
from its first one only (or from the end of the match before, ``\G``).

On top of that, terms that disclose an entity are found from the corpus: an
entity is a distinct base value; its terms are the words of the documents that
hold it.  A term's disclosure is the normalised pointwise mutual information

    log2(n * c(term, entity) / (c(term) * c(entity))) / log2(n / c(entity))

with counts of documents over the whole corpus; 1 means the term never occurs
without the entity.  Terms that two documents or more have together with an
entity and that reach the threshold are spans of the kind ``term`` in all
documents, with base spans or without.  ``sanitised`` generalises base spans to
their kind and removes terms.

All of it is DataFrame and SQL functions.  Texts are shuffled only of documents
with base spans; of all others only the words that a fixed bit map lets through
are.  A document meets its terms by the MD5 of its text; up to
``BROADCAST_ROWS`` texts with terms are broadcast, beyond that texts are
shuffled to them.

Results for odd inputs: a null text counts as empty and has no spans; null ids
stay null; repeated rows give a row each, and count as documents; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packs import checkpointed, looked_up

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Words of at least so many letters.
TERM = r"\p{L}{4,}"
THRESHOLD, MIN_DOCS = 0.9, 2
#: Bits of a map of words (two a word): 32 for each word, between these.
MAP_BITS = (1 << 16, 1 << 26)
#: Numbers of 64 bits in a line of the map.
ROW = 1024
#: Entries that are folded at a time.
PART = 256
#: Texts with terms that are broadcast at most.
BROADCAST_ROWS = 100_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    doubled = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.try_element_at(F.array(part(p).try_cast("int")), F.lit(1)) <= 255))
    n = F.length(_digits(x))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(x)).otherwise(False)
    return n.between(8, 15)


_SPANS = "array<struct<start: int, end: int, match: string>>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(values: Column) -> Column:
    """An array in parts of PART."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PART).cast("int")), lambda k: F.slice(values, k * PART + 1, F.lit(PART)))


def _folded(values: Column, start: int, combine) -> Column:
    """What an array of numbers comes to before each place, and after the last.
    A fold that grows an array copies it each time, so parts are folded apart,
    and their results once more: steps follow the length, not its square."""
    grow = lambda a, x: F.concat(a, F.array(combine(F.element_at(a, F.lit(-1)), x)))
    scan = lambda xs: F.aggregate(xs, F.array(F.lit(start)), grow)

    def of_parts(scanned: Column) -> Column:
        ends = scan(F.transform(scanned, lambda p: F.element_at(p, F.lit(-1))))
        # a part's last entry is the next one's first
        inner = lambda e: F.flatten(F.transform(scanned, lambda p, k: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: combine(x, F.get(e, k)))))
        return _let(ends, lambda e: F.concat(inner(e), F.slice(e, F.size(e), F.lit(1))))

    return _let(values, lambda vs: F.when(F.size(vs) > 0, _let(F.transform(_parts(vs), scan), of_parts)).otherwise(F.array(F.lit(start))))


def _placed(text: Column, pattern: Column) -> Column:
    """Matches of a pattern with their places, in code points: what stands
    between matches tells where they start."""
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))

    def spans(s: Column) -> Column:
        lengths = F.transform(s, lambda x: F.length(x["before"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
        ends = lambda e: F.transform(F.filter(s, lambda x: x["match"].isNotNull()), lambda x, i: F.struct((F.get(e, i + 1) - F.length(x["match"])).alias("start"), F.get(e, i + 1).alias("end"), x["match"].alias("match")))
        return _let(_folded(lengths, 0, lambda a, x: a + x), ends)

    return _let(steps, spans).cast(_SPANS)


def _base(kind: str, text: Column) -> Column:
    pattern, clue = {"email": (EMAIL, text.contains("@")), "ip": (IP, text.rlike(r"[0-9]\.[0-9]")), "card": (CARD, text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")), "phone": (PHONE, text.contains("+"))}[kind]
    none = F.array().cast(_SPANS)
    spans = F.when(clue, _placed(text, F.lit(pattern))).otherwise(none)
    return F.filter(spans, lambda s: _valid(kind, s["match"]))


def _words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _terms(text: Column, words: Column) -> Column:
    """The places of words that are among the given ones.  These are dealt into
    as many buckets as their square root, so that neither side's number is
    multiplied by the other's."""
    n = lambda ws: F.greatest(F.ceil(F.sqrt(F.size(ws))), F.lit(1)).cast("int")
    bucket = lambda w, k: F.pmod(F.xxhash64(w), k).cast("int")
    dealt = lambda ws, k: F.transform(F.sequence(F.lit(0), k - 1), lambda b: F.filter(ws, lambda w: bucket(w, k) == b))
    among = lambda bs, k: F.filter(_placed(text, F.lit(TERM)), lambda s: F.array_contains(F.get(bs, bucket(F.lower(s["match"]), k)), F.lower(s["match"])))
    return _let(words, lambda ws: _let(n(ws), lambda k: _let(dealt(ws, k), lambda bs: among(bs, k))))


def _bits(term: Column, n_bits: int) -> list[Column]:
    h = F.xxhash64(term)
    return [F.pmod(x, F.lit(n_bits)).cast("int") for x in (h, F.shiftright(h, 32))]


def _map_of(words: DataFrame) -> tuple[Column, int]:
    """The bits of a table's words as one literal, and their number."""
    n_bits = min(MAP_BITS[1], max(MAP_BITS[0], 1 << (32 * words.agg(F.approx_count_distinct("word")).first()[0]).bit_length()))
    bits = words.select(F.explode(F.array(*_bits(F.col("word"), n_bits))).alias("bit"))
    flags = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("flags"))
    # a line for every ROW of them: a thousand lines at most
    line = flags.groupBy(F.floor(F.col("at") / ROW).cast("int").alias("line")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("at") % ROW, "flags"))).alias("m"))
    shown = F.transform(F.sequence(F.lit(0), F.lit(ROW - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")).cast("string"))
    lines = [",".join(["0"] * ROW)] * (n_bits // 64 // ROW)
    for r in line.select("line", F.array_join(shown, ",").alias("text")).collect():
        lines[r["line"]] = r["text"]
    return F.split(F.lit(",".join(lines)), ",").cast("array<bigint>"), n_bits


def _let_through(known: tuple[Column, int], words: Column) -> Column:
    """The words of an array whose bits a map has."""
    flags, n_bits = known
    has = lambda b: F.getbit(F.element_at(flags, F.shiftright(b, 6) + 1), b.bitwiseAND(63)) == 1
    return F.filter(words, lambda w: has(_bits(w, n_bits)[0]) & has(_bits(w, n_bits)[1]))


def _pairs(having: DataFrame, min_docs: int) -> DataFrame:
    """Checkpointed (word, c_both, c_entity) of having(row, text, entities): how
    often words stand with entities, of which min_docs rows at least have both.

    Entities of the same rows have the same counts, and so have words: classes
    of them are paired, one of each, so that a text of very many of both isn't
    multiplied out.  Classes are told by 128 bits of their rows and their number."""
    rows = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"rows{k}") for k in (0, 1)]
    same = ["n", "rows0", "rows1"]

    def classed(of: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(name, class) of what min_docs rows have, and (row, class)."""
        counted = of.groupBy(name).agg(F.count("*").alias("n"), *rows).where(F.col("n") >= min_docs)
        first = counted.groupBy(*same).agg(F.min(name).alias("class"))
        members = checkpointed(counted.join(first, same).select(name, "class", "n"))
        one = members.where(F.col(name) == F.col("class")).select(F.col("class").alias(name))
        return members, of.join(one, name).withColumnRenamed(name, "class")

    entities, of_entity = classed(having.select("row", F.explode("entities").alias("entity")), "entity")
    of_entity = checkpointed(of_entity)
    texts = having.select("row", "text").join(of_entity.select("row").distinct(), "row", "left_semi")
    words, of_word = classed(texts.select("row", F.explode(_words(F.col("text"))).alias("word")), "word")
    both = of_word.withColumnRenamed("class", "w").join(of_entity.withColumnRenamed("class", "e"), "row")
    met = both.groupBy("w", "e").agg(F.count("*").alias("c_both")).where(F.col("c_both") >= min_docs)
    told = met.join(entities.select(F.col("entity").alias("e"), F.col("n").alias("c_entity")), "e").select(F.col("w").alias("class"), "c_both", "c_entity").distinct()
    return checkpointed(words.select("word", "class").join(told, "class").drop("class"))


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone, term, text): arrays of spans (start,
    end, match) in code points, end exclusive; text only where there are any."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    based = rows.select("doc_id", "text", *[_base(k, F.col("text")).alias(k) for k in KINDS])
    any_span = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    none = F.array().cast(_SPANS)
    entities = F.array_distinct(F.transform(F.concat(*KINDS), lambda s: s["match"]))
    having = checkpointed(based.where(any_span).select(F.monotonically_increasing_id().alias("row"), "text", entities.alias("entities")))

    pairs = _pairs(having, min_docs)
    unmarked = based.withColumn("text", F.when(any_span, F.col("text"))).withColumn("term", none)
    if pairs.isEmpty():
        return unmarked

    # a row's repeats go before the shuffle, which then moves one row a word and task
    of_word = rows.select(F.explode(_let_through(_map_of(pairs), _words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("c_word"))
    n = rows.count()
    npmi = F.log2(F.lit(float(n)) * F.col("c_both") / (F.col("c_word") * F.col("c_entity"))) / F.log2(F.lit(float(n)) / F.col("c_entity"))
    telling = checkpointed(pairs.join(of_word, "word").where((F.col("c_entity") < n) & (npmi >= threshold)).select("word").distinct())
    if telling.isEmpty():
        return unmarked

    key = F.md5(F.col("text").cast("binary"))
    passed = rows.select("text", _let_through(_map_of(telling), _words(F.col("text"))).alias("words")).where(F.size("words") > 0)
    passed = passed.select(key.alias("key"), F.explode("words").alias("word"))
    told = checkpointed(passed.join(telling, "word").groupBy("key").agg(F.collect_set("word").alias("words")))
    keyed = based.withColumn("key", key)
    if told.count() <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(told), "key", "left")
    else:  # only rows that the map lets through can have terms; the others, empty ones say, meet nothing
        can = F.size(_let_through(_map_of(telling), _words(F.col("text")))) > 0
        met = looked_up(keyed.where(can), told, "key").unionByName(keyed.where(~can).withColumn("words", F.lit(None).cast("array<string>")))
    marked = met.withColumn("term", F.when(F.col("words").isNotNull(), _terms(F.col("text"), F.col("words"))).otherwise(none))
    return marked.select("doc_id", F.when(any_span | F.col("words").isNotNull(), F.col("text")).alias("text"), *KINDS, "term")


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind in the order given, then start."""
    named = lambda k: lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string"))
    parts = [F.transform(F.col(k), named(k)) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def _chunks(text: Column) -> Column:
    """A text in chunks of PART code points, so that pieces of it are found
    without counting from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0))


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text in chunks."""
    i, j = F.floor(start / PART).cast("int"), F.floor(end / PART).cast("int")
    from_, to = start % PART, end % PART
    last = F.coalesce(F.substring(F.get(chunks, j), F.lit(1), to), F.lit(""))
    apart = F.concat(F.coalesce(F.substring(F.get(chunks, i), from_ + 1, F.lit(PART)), F.lit("")), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), last)
    return F.when(end <= start, "").when(i == j, F.substring(F.get(chunks, i), from_ + 1, end - start)).otherwise(apart)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, clean_text) of the documents with spans or terms: base spans generalised
    to ``[kind]``, disclosing terms removed.  Of spans that overlap the first
    one's name stands for all."""
    found = find_personal_data(docs, id_col=id_col, text_col=text_col, **options).where("text is not null")
    by = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k}]" if k != "term" else "").alias("by"))
    tagged = F.array_sort(F.concat(*[F.transform(F.col(k), by(k)) for k in (*KINDS, "term")]))

    def pieces(spans: Column) -> Column:
        """Before each span what is between it and the end of all before it,
        then its name, unless it overlaps one of those."""
        shown = lambda c, e: F.transform(spans, lambda s, i: F.when(s["start"] < F.get(e, i), F.lit("")).otherwise(F.concat(_piece(c, F.get(e, i), s["start"]), s["by"])))
        rest = lambda c, e: F.array(_piece(c, F.element_at(e, F.lit(-1)), F.length("text")))
        ends = _folded(F.transform(spans, lambda s: s["end"]), 0, F.greatest)
        return _let(_chunks(F.col("text")), lambda c: _let(ends, lambda e: F.array_join(F.concat(shown(c, e), rest(c, e)), "")))

    return found.select("doc_id", _let(tagged, pieces).alias("clean_text"))
