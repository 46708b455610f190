"""Personal data by patterns, and terms that give protected entities away by corpus co-occurrence.

Everything is built-in functions. A pattern's places come from splitting the text at the pattern: the
pieces between and the matches themselves add up to code-point positions.

The information-theoretic part: every detected value is a protected entity. Its contexts are the
whole texts that hold it, without the values themselves. Texts where it has the same neighbourhood
are one sighting (copies of a document prove nothing). With n distinct texts in the corpus, with or
without personal data, n_t of them with the term, a term t and an entity e share
PMI(t; e) = log2(n_te n / (n_t n_e)) bits, out of the IC(e) = log2(n / n_e) bits that name e. The
disclosed share is PMI / IC:

* of a word it is smoothed to ``n_te / (n_te + discount)`` of itself, since rare words meet rare values by
  chance: one sighting never reaches ``generalise``, two do where the word is hardly found elsewhere;
* a code (a run of at least ``code_chars`` letters and digits, with a digit: keys, account numbers) doesn't
  meet anything by chance, so one sighting counts whole. It is assessed with its text's rarest entity,
  whose share is the largest.

From ``generalise`` on the term is generalised in the documents that hold both; from ``remove`` on it is
removed, and also where the ``context`` code points beside e alone give that share in ``support`` contexts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh_names

KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "name": "[NAME]"}

#: Near contexts of an entity that must hold a term; shares of the entity's information.
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Smoothing of a pair's count: one sighting gives at most 0.75 of the share, two 0.86, four 0.92.
DISCOUNT = 1 / 3
#: Code points of text on either side of a place that are its neighbourhood.
CONTEXT = 64
#: Digests and terms are broadcast up to this many (about 100 bytes each), joined by shuffle beyond.
BROADCAST_ROWS = 100_000
#: Letters and digits of a code.
CODE_CHARS = 12
#: Code points of a block in which a text is put together again, and of the longest value whose end is looked at with its start.
BLOCK, LONGEST = 1 << 14, 1 << 12


@dataclass(frozen=True)
class Disclosure:
    """The thresholds; see the module's head."""

    generalise: float = GENERALISE
    remove: float = REMOVE
    support: int = SUPPORT
    discount: float = DISCOUNT
    code_chars: int = CODE_CHARS


# The contract's patterns, written so that Java neither recurses nor tries a run again from its middle:
# a match that fails at the start of a run fails everywhere in it.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
# Whole runs of digits and single separators; only those of at least 12 digits can count.
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORD = r"(?<![\p{L}\p{N}])\p{L}{3,}(?![\p{L}\p{N}])"
# Terms of whole texts: runs of letters and digits, and the pairs of characters of scripts without spaces.
_TERM = r"[\p{L}\p{N}]{2,}+"
# Han and kana by ranges: Java looks a script up character by character.
_DENSE = r"[\u3005\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{323af}]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


#: What a match must fulfil besides its pattern.
_VALID = {
    "ip": lambda s: s["value"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda s: F.length(_digits(s["value"])).between(12, 19) & F.call_function("luhn_check", _digits(s["value"])),
    "phone": lambda s: F.length(_digits(s["value"])).between(9, 15),
}


_SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>"


def _scan(values: Column, plus: Callable[[Column, Column], Column], levels: int = 3, width: int = 64) -> Column:
    """struct(total, list): what ``plus`` makes of the values (ints) before each one, from 0 on.

    Appending to a list copies it, so long lists are scanned in chunks, and chunks of chunks.
    """
    nothing = F.expr("cast(array() as array<int>)")

    def short(items: Column) -> Column:
        return F.aggregate(
            items, F.struct(F.lit(0).alias("total"), nothing.alias("list")),
            lambda acc, x: F.struct(plus(acc["total"], x).cast("int").alias("total"), F.array_append(acc["list"], acc["total"]).alias("list")),
        )

    def scan(items: Column, level: int) -> Column:
        if level == 0:
            return short(items)
        size = F.lit(width**level)
        starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))
        parts = F.transform(F.transform(starts, lambda i: F.slice(items, i * size + 1, size)), lambda c: scan(c, level - 1))
        return F.aggregate(
            parts, F.struct(F.lit(0).alias("total"), F.expr("cast(array() as array<array<int>>)").alias("lists")),
            lambda acc, p: F.struct(plus(acc["total"], p["total"]).cast("int").alias("total"), F.array_append(acc["lists"], F.transform(p["list"], lambda x: plus(acc["total"], x).cast("int"))).alias("lists")),
            lambda acc: F.struct(acc["total"].alias("total"), F.flatten(acc["lists"]).alias("list")),
        )

    out = short(values)
    for level in range(1, levels):
        out = F.when(F.size(values) > width**level, scan(values, level)).otherwise(out)
    return out


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once, however often and in whichever loops the body names it."""
    return F.transform(F.array(value), body)[0]


def _places(text: Column, pattern: Column, kind: Column, kind_no: int) -> Column:
    """Spans (start, kind_no, kind, end, value) of a pattern's matches, ends exclusive."""
    made = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))

    def spans(x: Column) -> Column:
        pairs = F.zip_with(x["matches"], F.slice(x["gaps"], 1, F.size(x["matches"])), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        before = _let(F.transform(pairs, lambda p: p["g"] + F.length(p["m"])), lambda steps: _scan(steps, _sum)["list"])
        return F.zip_with(
            pairs, before,
            lambda p, at: F.struct((at + p["g"]).alias("start"), F.lit(kind_no).alias("kind_no"), kind.alias("kind"), (at + p["g"] + F.length(p["m"])).alias("end"), p["m"].alias("value")),
        )

    return _let(made, spans).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """All valid spans of the four kinds, by start and kind. ``text`` isn't null."""
    nothing = F.expr(f"cast(array() as {_SPAN})")
    gates = {"email": text.contains("@"), "phone": text.contains("+") & text.rlike(r"\+[0-9]"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[ -]?[0-9]){11}")}
    patterns = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
    found = []
    for no, kind in enumerate(KINDS):
        spans = _places(text, F.lit(patterns[kind]), F.lit(kind), no)
        if kind in _VALID:
            spans = F.filter(spans, _VALID[kind])
        found.append(F.when(gates[kind], spans).otherwise(nothing))
    return F.when(text.contains("@") | text.rlike("[0-9]"), F.array_sort(F.concat(*found))).otherwise(nothing)


def _join_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def contexts(texts: DataFrame) -> DataFrame:
    """digest, entity, before, after: the places of protected entities; ``texts`` has digest, text and base.

    Long texts are cut into blocks with what stands beside them, as in ``_rebuilt``. Of a value longer than
    ``LONGEST`` code points what follows isn't looked at.
    """
    lead = lambda low: F.least(low, F.lit(CONTEXT))
    starts = F.sequence(F.lit(0), F.floor(F.length("text") / BLOCK).cast("int"))
    cut = F.transform(starts, lambda i: F.struct((i * BLOCK).alias("low"), F.substr("text", i * BLOCK - lead(i * BLOCK) + 1, F.lit(BLOCK + LONGEST + 2 * CONTEXT)).alias("t")))
    blocks = texts.where(F.size("base") > 0).select("digest", "base", F.explode(cut).alias("x"))
    low, t = F.col("x.low"), F.col("x.t")
    at = lambda place: place - low + lead(low)
    around = lambda s: F.struct(
        F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"),
        F.substr(t, F.greatest(at(s["start"]) - CONTEXT, F.lit(0)) + 1, F.least(at(s["start"]), F.lit(CONTEXT))).alias("before"),
        F.when(s["end"] - s["start"] <= LONGEST, F.substr(t, at(s["end"]) + 1, F.lit(CONTEXT))).otherwise("").alias("after"),
    )
    inside = F.filter("base", lambda s: (s["start"] >= low) & (s["start"] < low + BLOCK))
    return blocks.select("digest", F.explode(F.transform(inside, around)).alias("s")).select("digest", "s.*")


def revealing_terms(places: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """entity, term, share: what exceeds the thresholds in the near contexts alone. Copies of a context count once.

    A context's first and last word may be cut off, so words at its outer edges are left out.
    """
    own = places.select("entity", "before", "after").distinct()
    words = F.array_distinct(F.transform(F.concat(
        F.regexp_extract_all(F.regexp_replace("before", r"^[\p{L}\p{N}]+", ""), F.lit(_WORD), F.lit(0)),
        F.regexp_extract_all(F.regexp_replace("after", r"[\p{L}\p{N}]+$", ""), F.lit(_WORD), F.lit(0)),
    ), F.lower))
    seen = own.select("entity", words.alias("words"))
    n = seen.agg(F.count(F.lit(1)).cast("double").alias("n"))
    n_e = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    both = seen.select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
    n_t = both.groupBy("term").agg(F.sum("n_te").alias("n_t"))
    often = both.where(F.col("n_te") >= rule.support)
    pmi = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e")))
    ic = F.log2(F.col("n") / F.col("n_e"))
    # One row of one number: its size is fixed.
    scored = often.join(n_e, "entity").join(n_t, "term").crossJoin(F.broadcast(n))
    return scored.where(F.col("n") > F.col("n_e")).select("entity", "term", (pmi / ic).alias("share")).where(F.col("share") >= rule.generalise)



def _regions(spans: Column, size: Column) -> Column:
    """Parts (a, b, e, kind) of a text of ``size`` code points: a to b is free, b to e is hidden under the label of ``kind``.

    ``spans`` are sorted by start. Spans that overlap an earlier one are hidden with it; the last part hides nothing.
    """

    def kept(spans: Column, scan: Column) -> Column:
        both = F.zip_with(spans, scan["list"], lambda s, at: F.struct(at.alias("a"), s["start"].alias("b"), s["kind"].alias("kind")))
        return F.concat(F.filter(both, lambda x: x["b"] >= x["a"]), F.array(F.struct(scan["total"].alias("a"), size.alias("b"), F.lit("").alias("kind"))))

    def ended(parts: Column) -> Column:
        ends = F.concat(F.slice(F.transform(parts, lambda x: x["a"]), 2, F.size(parts)), F.array(size))
        return F.zip_with(parts, ends, lambda x, e: F.struct(x["a"].alias("a"), x["b"].alias("b"), e.alias("e"), x["kind"].alias("kind")))

    scanned = lambda own: _let(F.transform(own, lambda s: s["end"]), lambda ends: _let(_scan(ends, F.greatest), lambda scan: kept(own, scan)))
    return _let(spans, lambda own: _let(scanned(own), ended))


def _rebuilt(text: Column, parts: Column, label: Callable[[Column], Column]) -> Column:
    """The text with each hidden part replaced by ``label(part)``.

    A place in a text is found by counting from its start, so a long text is cut into blocks first.
    """
    starts = F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda i: F.struct((i * BLOCK).alias("low"), F.substr(text, i * BLOCK + 1, F.lit(BLOCK)).alias("t")))

    def block(x: Column, parts: Column) -> Column:
        low, high = x["low"], x["low"] + BLOCK

        def part(p: Column) -> Column:
            start = F.greatest(p["a"], low)
            free = F.substr(x["t"], start - low + 1, F.greatest(F.least(p["b"], high) - start, F.lit(0)))
            return F.concat(free, F.when((p["b"] >= low) & (p["b"] < high), label(p)).otherwise(""))

        return F.array_join(F.transform(F.filter(parts, lambda p: (p["a"] < high) & (p["b"] >= low)), part), "")

    return _let(parts, lambda made: F.array_join(F.transform(blocks, lambda x: block(x, made)), ""))


def _masked(texts: DataFrame) -> DataFrame:
    """digest, masked (the text with its protected values as spaces) of ``texts`` (digest, text, base)."""
    parts = texts.select("digest", "text", _regions(F.col("base"), F.length("text")).alias("parts"))
    return parts.select("digest", _rebuilt(F.col("text"), F.col("parts"), lambda p: F.repeat(F.lit(" "), p["e"] - p["b"])).alias("masked"))


def _terms(text: Column) -> Column:
    """The distinct terms of a text: runs of two or more letters or digits, and pairs of characters of dense scripts."""
    runs = F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
    pairs = F.when(text.rlike(_DENSE), F.regexp_extract_all(text, F.lit(rf"(?=({_DENSE}{{2}}))"), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.transform(F.concat(runs, pairs), F.lower))


def _is_code(term: Column, rule: Disclosure) -> Column:
    return (F.length(term) >= rule.code_chars) & term.rlike(r"\p{N}")


def _few(df: DataFrame) -> DataFrame:
    """A written table, broadcast only when small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _distinct(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """``texts`` with one row a digest; only those of ``copies`` (digests that repeat) are shuffled."""
    few = _few(copies).select("digest")
    return texts.join(few, "digest", "left_anti").unionByName(texts.join(few, "digest", "left_semi").dropDuplicates(["digest"]))


def sightings(places: DataFrame, scratch: Scratch) -> DataFrame:
    """entity, digest, sight, n_e, d_e: the texts of each entity, its sightings and texts counted; entities and sightings are numbers.

    Of entities that stand in the same texts in the same way only the first is listed, since all share their
    terms: a text of many values that is copied and edited makes no more pairs than one value of it.
    """
    held = scratch.save(places.groupBy("entity", "digest").agg(F.min(F.sha1(F.concat_ws("\0", "before", "after").cast("binary"))).alias("near")))
    # A sighting is named by its first text, so that entities can be compared.
    first = scratch.save(held.groupBy("entity", "near").agg(F.min("digest").alias("first")).withColumn("sight", F.monotonically_increasing_id()))
    named = scratch.save(held.join(first, ["entity", "near"]).select("entity", "digest", "first", "sight"))
    mark = lambda salt: F.sum(F.xxhash64("digest", "first", F.lit(salt)).cast("decimal(38,0)"))
    counted = named.groupBy("entity").agg(F.countDistinct("sight").alias("n_e"), F.count(F.lit(1)).alias("d_e"), mark(1).alias("m1"), mark(2).alias("m2"))
    apart = counted.groupBy("m1", "m2", "n_e", "d_e").agg(F.min("entity").alias("entity"))
    apart = scratch.save(apart.select("entity", "n_e", "d_e", F.monotonically_increasing_id().alias("number")))
    return scratch.save(named.join(apart, "entity").select("entity", "number", "digest", "sight", "n_e", "d_e"))


def _most_texts(n: Column | float, n_e: Column, rule: Disclosure) -> Column:
    """In how many texts a word can stand at most for an entity of n_e sightings to be revealed by it: at n_te = n_e."""
    smooth = n_e / (n_e + rule.discount)
    return n_e * F.pow(F.lit(n) / n_e, 1 - rule.generalise / smooth) * (1 + 1e-9)


def shared_pairs(held: DataFrame, words: DataFrame, total: int, rule: Disclosure, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Two tables of number (the entity), n_e, d_e, sight, digest, term: words of recurring entities, and codes with each text's rarest entity.

    An entity of one sighting has no word that reaches a threshold, so its texts' words aren't listed. Neither are
    words that stand in too many of the texts with values alone; that table is written, counted, and used when small.
    """
    columns = ("number", "n_e", "d_e", "sight", "digest", "term")
    recurring = _few(scratch.save(held.where("n_e > 1").drop("entity")))
    often = words.join(recurring, "digest").withColumn("term", F.explode("words")).select(*columns)
    common = scratch.save(words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("h_t")).where("h_t > 4"))
    if common.count() <= BROADCAST_ROWS:
        most = F.col("d_e") + _most_texts(float(total), F.col("n_e"), rule)
        often = often.join(F.broadcast(common), "term", "left").where(F.col("h_t").isNull() | (F.col("h_t") <= most)).select(*columns)
    rarest = held.groupBy("digest").agg(F.min(F.struct("n_e", "d_e", "entity", "number", "sight")).alias("r")).select("digest", "r.*")
    codes = words.select("digest", F.explode(F.filter("words", lambda w: _is_code(w, rule))).alias("term")).join(rarest, "digest").select(*columns)
    return often, codes


def corpus_counts(texts: DataFrame, terms: DataFrame, copies: DataFrame) -> DataFrame:
    """term, d_t: the distinct texts of the corpus that hold each of ``terms``.

    ``texts`` has digest, text and base, ``copies`` the digests of repeated texts. Texts without personal data
    count like all others; copies add up to one text.
    """
    each = texts.join(_few(copies), "digest", "left")
    # Values aren't terms: they are taken out where there are any.
    parts = F.when(F.size("base") > 0, _regions(F.col("base"), F.length("text")))
    hidden = _rebuilt(F.col("text"), F.col("parts"), lambda p: F.lit(" "))
    rows = each.select(F.coalesce("copies", F.lit(1)).alias("copies"), "text", parts.alias("parts"))
    rows = rows.select("copies", F.when(F.col("parts").isNull(), F.col("text")).otherwise(hidden).alias("free"))
    seen = rows.select((F.lit(1.0) / F.col("copies")).alias("part"), F.explode(_terms(F.col("free"))).alias("term"))
    if terms.count() <= BROADCAST_ROWS:
        seen = seen.join(F.broadcast(terms), "term", "left_semi")
    return seen.groupBy("term").agg(F.round(F.sum("part")).alias("d_t")).join(terms, "term", "left_semi")


def corpus_terms(texts: DataFrame, places: DataFrame, scratch: Scratch, rule: Disclosure) -> DataFrame | None:
    """digest, term, removed: what exceeds the thresholds in each text, by counts over the whole corpus; None where nothing can."""
    held = sightings(places, scratch)
    digests = scratch.save(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")))
    total, copies = digests.count(), scratch.save(digests.where("copies > 1"))
    words = scratch.save(_masked(_distinct(texts.where(F.size("base") > 0), copies)).select("digest", _terms(F.col("masked")).alias("words")))
    often, codes = shared_pairs(held, words, total, rule, scratch)

    def counted(seen: DataFrame, least: int, discount: float) -> DataFrame:
        # A text holds an entity and a term once in these tables, so rows are texts.
        pairs = seen.groupBy("number", "term").agg(F.countDistinct("sight").alias("n_te"), F.count(F.lit(1)).alias("d_te"), F.min("n_e").alias("n_e"), F.min("d_e").alias("d_e"))
        return pairs.where(F.col("n_te") >= least).withColumn("discount", F.lit(float(discount)))

    pairs = scratch.save(counted(often, 2, rule.discount).unionByName(counted(codes, 1, 0.0)))
    if pairs.first() is None:  # the corpus needn't be counted
        return None
    counts = corpus_counts(texts, scratch.save(pairs.select("term").distinct()), copies)
    # Texts that are one sighting of the entity count as one of n and n_t as well.
    n, n_t = F.lit(float(total)) - F.col("d_e") + F.col("n_e"), F.col("d_t") - F.col("d_te") + F.col("n_te")
    share = F.log2(F.col("n_te") * n / (n_t * F.col("n_e"))) / F.log2(n / F.col("n_e")) * F.col("n_te") / (F.col("n_te") + F.col("discount"))
    scored = pairs.join(counts, "term").where(n > F.col("n_e")).select("number", "term", share.alias("share")).where(F.col("share") >= rule.generalise)
    scored = scored.groupBy("number", "term").agg(F.max("share").alias("share"))
    near = revealing_terms(places, rule).join(held.select("entity", "number").distinct(), "entity").select("number", "term", F.col("share").alias("near"))
    removed = F.greatest("share", F.coalesce("near", F.lit(0.0))) >= rule.remove
    flagged = scratch.save(scored.join(near, ["number", "term"], "left").select("number", "term", removed.alias("removed")))
    flagged_few = _few(flagged)
    there = often.join(flagged_few, ["number", "term"]).unionByName(codes.join(flagged_few, ["number", "term"]))
    return scratch.save(there.groupBy("digest", "term").agg(F.bool_or("removed").alias("removed")))


def term_spans(texts: DataFrame, flagged: DataFrame, scratch: Scratch) -> DataFrame:
    """digest, extra: the places of the flagged terms (digest, term, removed) in each text, overlapping ones of a kind as one."""
    listed = _few(scratch.save(flagged.select("digest").distinct()))
    own = texts.where(F.size("base") > 0).join(listed, "digest", "left_semi").dropDuplicates(["digest"])
    masked = scratch.save(_masked(own))
    spot = lambda start, value: F.struct(start.alias("start"), value.alias("value"))
    runs = F.transform(_places(F.col("masked"), F.lit(_TERM), F.lit(""), 0), lambda s: spot(s["start"], F.lower(s["value"])))
    dense = F.transform(_places(F.col("masked"), F.lit(rf"{_DENSE}{{2,}}+"), F.lit(""), 0), lambda s: F.transform(
        F.sequence(F.lit(0), F.length(s["value"]) - 2), lambda i: spot(s["start"] + i, F.lower(F.substr(s["value"], i + 1, F.lit(2))))
    ))
    spots = F.when(F.col("masked").rlike(_DENSE), F.concat(runs, F.flatten(dense))).otherwise(runs)
    at = masked.select("digest", F.explode(spots).alias("s")).select("digest", F.col("s.value").alias("term"), F.col("s.start").alias("start"))
    found = at.join(flagged, ["digest", "term"]).select("digest", "removed", F.struct("start", F.lit("").alias("kind"), (F.col("start") + F.length("term")).alias("end")).alias("s"))
    lists = found.groupBy("digest", "removed").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    merged = F.filter(_regions(F.col("spans"), F.lit(2**31 - 1)), lambda p: p["e"] < 2**31 - 1)
    kind, number = F.when(F.col("removed"), "term").otherwise("name"), F.when(F.col("removed"), 4).otherwise(5)
    spans = F.transform(merged, lambda p: F.struct(p["b"].alias("start"), number.alias("kind_no"), kind.alias("kind"), p["e"].alias("end"), F.lit("").alias("value"))).cast(_SPAN)
    return scratch.save(lists.select("digest", spans.alias("spans")).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("extra")))


def find_spans(docs: DataFrame, base: str, spans: str, rule: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with text as a string that isn't null, and the columns ``base`` and ``spans`` (base and terms), each sorted.

    The rows are written once with their base spans, and everything else reads that table. Only texts
    with a revealing term are looked up; the table of these is written, counted, and broadcast only when small.
    """
    scratch = Scratch(docs.sparkSession)
    digest, extra, there = fresh_names([*docs.columns, base, spans], "__digest", "__extra", "__there")
    full = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    full = scratch.save(full.withColumn(base, base_spans(F.col("text"))).withColumn(digest, F.sha1(F.col("text").cast("binary"))))
    texts = full.select(F.col(digest).alias("digest"), "text", F.col(base).alias("base"))
    places = scratch.save(contexts(texts))
    flagged = corpus_terms(texts, places, scratch, rule)
    if flagged is None or flagged.first() is None:
        scratch.drop_all_but(full)
        return full.withColumn(spans, F.col(base)).drop(digest)
    found = term_spans(texts, flagged, scratch)
    scratch.drop_all_but(full, found)
    found = _few(found).select(F.col("digest").alias(there), F.col("extra").alias(extra))
    own = F.when(F.size(base) > 0, F.col(digest))  # texts without values aren't looked up
    joined = full.join(found, own == F.col(there), "left")
    return joined.withColumn(spans, F.when(F.col(extra).isNotNull(), F.array_sort(F.concat(base, extra))).otherwise(F.col(base))).drop(digest, extra, there)


def find_personal_data(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """Counts and places of personal data, one row per row of ``docs`` (doc_id, text).

    A null text is empty: no spans, the digest of an empty string. Repeated rows and null doc_ids stay;
    other columns are ignored; an empty table gives no rows. Places of different kinds may overlap; equal
    texts get equal spans.
    """
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "base", "spans", rule)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(_join_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), _join_spans(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with every span of its texts replaced by a label; null texts stay null, others without a span as they are.

    Of spans that overlap, the first one's label stands for all. All other columns are kept, whatever their
    names; where there is a column n_chars it becomes the new text's length. An empty table gives no rows.
    """
    columns = docs.columns
    null, base, spans, parts = fresh_names(columns, "__null", "__base", "__spans", "__parts")
    found = find_spans(docs.withColumn(null, F.col("text").isNull()), base, spans, rule)
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    done = found.withColumn(parts, F.when(F.size(spans) > 0, _regions(F.col(spans), F.length("text"))))
    hidden = _rebuilt(F.col("text"), F.col(parts), lambda p: F.coalesce(label[p["kind"]], F.lit("")))
    text = F.when(F.col(null), F.lit(None).cast("string")).when(F.col(parts).isNull(), F.col("text")).otherwise(hidden)
    done = done.withColumn("text", text)
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*columns)
