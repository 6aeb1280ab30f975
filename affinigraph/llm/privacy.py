"""Sanitising personal data, with DataFrame expressions only.

Patterns find the protected entities. Terms that reveal an entity are found in the corpus: over distinct lines, the
pointwise mutual information of a term and an entity is compared with the entity's information content. A term for which
log p(c, t) / (p(c) p(t)) reaches ``disclosure`` times -log p(c) is disclosing: it is generalised or removed in the documents
that name the entity. Every entity is judged; a pair on fewer than ``support`` lines counts DISCOUNT lines less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_struct, from_struct, joined_by, materialize, sent_if_small
from .lines import in_sorted
from .words import bound

#: What a pair on few lines counts less, so that chance in a small corpus is not disclosing.
DISCOUNT = 0.5

#: Kinds in reporting order. Each pattern finds the same leftmost matches as its plain form, but a run is tried once, from
#: its start or from the end of the last match, and loops are possessive: no text makes them slow.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
MASKS = {k: f"[{k.upper()}]" for k in (*KINDS, "term")}
SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"
_BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
_WORD = r"[^\s\p{Punct}]+"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit is doubled and its digits are summed."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    at = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(_BYTE))
    if kind == "card":
        d = _digits(value)
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _pieces(items: Column) -> Column:
    """An array as consecutive arrays of some sqrt(size) items; an empty one as one empty piece. A fold that appends to its
    state copies it each time, so folds run over a piece: n items cost n ** 1.5 references copied, not n ** 2."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), size)
    return bound(size, lambda n: F.transform(starts, lambda a: F.slice(items, a + 1, n)))


def _located(gaps: Column, found: Column, kind: str, wanted=None) -> Column:
    """Spans of the matches between the gaps that a split at them leaves, where ``wanted`` holds for the matched text; offsets
    in code points. Places count from the start of a piece of the matches, then the pieces before it are added."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.length(x["value"])
        own = F.array(F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["value"].alias("value"))).cast(SPAN)
        spans = F.concat(acc["spans"], own)
        if wanted is not None:
            spans = F.when(wanted(x["value"]), spans).otherwise(acc["spans"])
        return F.struct(b.alias("at"), spans.alias("spans"))

    def shifted(done: Column) -> Column:
        before = F.aggregate(done, F.array(F.lit(0).cast("long")), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d["at"])))
        moved = lambda by: lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))
        return bound(before, lambda at: F.flatten(F.transform(done, lambda d, i: F.transform(d["spans"], moved(F.get(at, i)))))).cast(SPAN)

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    return bound(bound(pairs, lambda p: F.transform(_pieces(p), lambda piece: F.aggregate(piece, start, step))), shifted)


def find(text: Column, kind: str) -> Column:
    """Valid matches of one kind in a text. Texts without the sign that every match has aren't scanned."""
    pattern = PATTERNS[kind]
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike(r"[0-9][0-9. -]{5}"))
    valid = _located(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), kind, lambda v: _valid(kind, v))
    return F.coalesce(F.when(hint, valid), F.array().cast(SPAN))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base_``, the valid spans by kind, then start. A null text has none."""
    cols = {f"{k}_": find(F.col(text), k) for k in KINDS}
    return docs.withColumns(cols).withColumn("base_", F.concat(*(f"{k}_" for k in KINDS))).drop(*cols)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def entity(value: Column) -> Column:
    """The form under which mentions of one entity agree: digits alone of a number, lower case of the rest."""
    lower = F.lower(value)
    return F.when(lower.contains("@"), lower).otherwise(_digits(lower))


def disclosing_terms(docs: DataFrame, disclosure: float, support: int, text: str) -> DataFrame:
    """(entity, term) pairs whose mutual information reaches the threshold, from counts over all distinct lines.

    Line copies count once, so that copied documents don't make their words look telling. Lines are told apart by a 64-bit
    hash, so that of n lines some n ** 2 / 2 ** 65 pairs count as one.

    Entities on the same lines (told by their number and two 64-bit sums of hashes) have the same counts, and a document that
    names one names all. The smallest stands for them, so a line of many addresses is not paired with its words for each.
    """
    lines = docs.where(F.col("base_").isNotNull() & (F.size("base_") > 0)).select(F.explode(F.split(text, "\n")).alias("line"))
    lines = lines.where(F.col("line").rlike(r"[@+]|[0-9][0-9. -]{5}"))
    lines = with_base(lines, "line").where(F.size("base_") > 0).groupBy(F.xxhash64("line").alias("h")).agg(F.min(F.struct("line", "base_")).alias("x"))
    lines = materialize(lines.select("h", F.array_distinct(F.transform("x.base_", lambda s: entity(s["value"]))).alias("entities"), F.col("x.line").alias("line")), "protected")
    named = lines.select("h", F.explode("entities").alias("entity"))
    alike = ["n_entity", "set_a", "set_b"]
    known = named.groupBy("entity").agg(F.count("*").alias("n_entity"), *(F.bit_xor(F.xxhash64("h", F.lit(c))).alias(f"set_{c}") for c in "ab"))
    known = materialize(known, "entities")
    first = materialize(known.groupBy(*alike).agg(F.min("entity").alias("entity")), "first")
    terms_of = lambda rows, *keep: rows.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(_WORD), F.lit(0)))).alias("term"))
    pairs = joined_by(named, first, ["entity"], F.col("h")).join(terms_of(lines, "h"), "h")
    pairs = pairs.where(F.col("term").rlike(r"\p{L}")).groupBy("entity", "term", *alike).agg(F.count("*").alias("n_both"))
    pairs = pairs.withColumn("n_both", F.when(F.col("n_both") < support, F.col("n_both") - DISCOUNT).otherwise(F.col("n_both")))
    everywhere = docs.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(F.split(text, "\n"))).alias("line"))
    total = F.lit(everywhere.select(F.xxhash64("line")).distinct().count())
    # The threshold bounds a telling term's lines by n_both (total / n_entity) ** (1 - disclosure). Protected lines alone
    # rule out common words, before all lines are counted.
    most = F.col("n_both") * F.pow(F.greatest(total, F.col("n_entity")) / F.col("n_entity"), F.lit(1 - disclosure)) * 1.001
    inside = materialize(terms_of(lines).groupBy("term").agg(F.count("*").alias("n_inside")), "inside")
    pairs = materialize(joined_by(pairs, inside, ["term"], F.col("entity")).where(F.col("n_inside") <= most).drop("n_inside"), "pairs")
    # An entity's own parts do not reveal it; they may reveal the others on the same lines.
    part = F.col("entity").contains(F.col("term"))
    others = known.withColumnRenamed("entity", "other")
    of_others = pairs.where(part).join(others, alike).where(~F.col("other").contains(F.col("term"))).drop("other").distinct()
    pairs = materialize(pairs.where(~part).unionByName(of_others), "revealing")
    terms = materialize(pairs.select("term").distinct(), "terms")
    words = terms_of(everywhere, F.xxhash64("line").alias("h"))
    seen = joined_by(words, terms, ["term"], F.col("h"), "left_semi").groupBy("term", "h").agg(F.count("*").alias("copies")).groupBy("term").agg(F.count("*").alias("n_term"))
    n = F.greatest(total, F.col("n_term"), F.col("n_entity"))
    pmi = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    information = F.log(n / F.col("n_entity"))
    return pairs.join(seen, "term").where(pmi >= disclosure * information).select("entity", "term")


def _halves(size: Column) -> Column:
    """The powers of two up to a size of 1 or more, falling."""
    return F.transform(F.sequence(F.floor(F.log2(size)).cast("int"), F.lit(0)), lambda b: F.pow(F.lit(2), b).cast("int"))


def _apart(words: Column, spans: Column) -> Column:
    """The words that overlap none of the spans, which are in order and apart: by halving, the last that begins before a word
    ends is the only one to look at."""

    def clear(w: Column, own: Column, steps: Column) -> Column:
        before = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(own, at + s - 1)["start"] < w["end"], at + s).otherwise(at))
        return bound(before, lambda n: (n == 0) | F.coalesce(F.get(own, n - 1)["end"] <= w["start"], F.lit(True)))

    return bound(spans, lambda own: bound(_halves(F.greatest(F.size(own), F.lit(1))), lambda steps: F.filter(words, lambda w: clear(w, own, steps))))


def sanitise(docs: DataFrame, disclosure: float = 0.8, support: int = 3, action: str = "generalise", key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``base`` and ``spans`` (arrays of kind, start, end, value) and ``clean_text``, in
    place of columns so named.

    Spans of disclosing terms follow the base spans. Overlapping spans are masked as one, under the kind of the first. Null
    texts have no spans and stay null; repeated rows get the same result each; ids may be null.
    """
    if action not in ("generalise", "remove"):
        raise ValueError("action must be generalise or remove")
    found = with_base(docs.select(as_struct(docs), F.col(text).alias("own_"), F.col(key).alias("of_"), F.xxhash64(key, text).alias("key_")), "own_")
    told = materialize(disclosing_terms(found, disclosure, support, "own_"), "disclosing")
    entities = found.where(F.size("base_") > 0).select("of_", "key_", F.explode(F.array_distinct(F.transform("base_", lambda s: entity(s["value"])))).alias("entity"))
    telling = (
        joined_by(entities, told, ["entity"], F.col("key_")).groupBy(F.col("of_").alias("of2_"), F.col("key_").alias("key2_"))
        .agg(F.sort_array(F.collect_set("term")).alias("terms_")).withColumn("steps_", _halves(F.size("terms_")))
    )
    telling = sent_if_small(materialize(telling, "telling"))
    with_terms = found.join(telling, F.col("of_").eqNullSafe(F.col("of2_")) & (F.col("key_") == F.col("key2_")), "left")
    words = F.regexp_extract_all(F.col("own_"), F.lit(_WORD), F.lit(0))
    telling_words = _located(F.split("own_", _WORD), words, "term", lambda v: in_sorted(F.lower(v), F.col("terms_"), F.col("steps_")))
    for kind in KINDS:
        telling_words = _apart(telling_words, F.filter("base_", lambda s: s["kind"] == kind))  # noqa: B023
    extra = F.when(F.col("terms_").isNull(), F.array().cast(SPAN)).otherwise(telling_words)
    out = with_terms.withColumn("spans_", F.concat("base_", extra))
    return from_struct(out, docs.columns, {"base": F.col("base_"), "spans": F.col("spans_"), "clean_text": masked(F.col("own_"), F.col("spans_"), action)})


def masked(text: Column, spans: Column, action: str) -> Column:
    """The text without the spans: each piece of the spans takes the part of the text from the last end before it to its own."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    mask = (lambda k: F.concat(F.lit("["), F.upper(k), F.lit("]"))) if action == "generalise" else (lambda k: F.lit(""))
    cut = lambda t, a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))

    def without(piece: Column, low: Column, high: Column, own: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            parts = F.concat(acc["parts"], F.array(cut(own, acc["at"] - low, s["start"] - low), mask(s["kind"])))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], parts).otherwise(acc["parts"]).alias("parts"))

        start = F.struct(low.alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(piece, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), cut(own, acc["at"] - low, high - low)))

    def of_pieces(pieces: Column) -> Column:
        last = lambda acc, p: F.greatest(F.element_at(acc, -1), F.array_max(F.transform(p, lambda s: s["end"])))
        ends = F.aggregate(pieces, F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(last(acc, p))))
        whole = F.length(text).cast("long")
        return bound(ends, lambda at: F.array_join(F.transform(pieces, lambda p, i: one(p, F.get(at, i), F.when(i == F.size(pieces) - 1, whole).otherwise(F.get(at, i + 1)))), ""))

    one = lambda p, low, high: bound(F.struct(low.alias("a"), high.alias("b")), lambda x: bound(cut(text, x["a"], x["b"]), lambda own: without(p, x["a"], x["b"], own)))
    return F.when(F.size(spans) == 0, text).otherwise(bound(bound(order, _pieces), of_pieces))
