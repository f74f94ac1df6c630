"""Personal data: pattern matches, and terms that reveal them by corpus co-occurrence. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .native import let, total

KINDS = ("email", "ip", "card", "phone")
PRIOR = 0.5  # weight, in texts, of an entity's overall share in its share among the texts of a term
DISCLOSURE = 0.9  # share of an entity's information content that a term may reveal
RUN = 128  # numbers whose running sums are taken together
PRUNE = 16  # part of the other texts that rules out common terms before the full count
MAX_TERMS = 100_000  # texts whose revealing terms go to the tasks; where there are more, their rows alone meet them in a shuffle
MAX_KEYS = 2_000_000  # keys of texts, 8 bytes each, that go to the tasks; more meet the texts in a shuffle

#: Each kind's pattern. They match what the plain patterns of the contract match, leftmost first: possessive repeats never give
#: back what a later part needs, and a match starts inside a run of its own characters only right after the match before it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a valid match of the kind has somewhere; others skip the search.
_HINTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
_WORD = r"\p{L}{2,}"
_FILLER = "\ua66e"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def check(d: Column) -> Column:
        n = F.length(d)
        each = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(d, n - i + 1, F.lit(1)).cast("int"), lambda x: F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)).cast("long"))
        return F.when(n.between(14, 19), total(each) % 10 == 0).otherwise(F.lit(False))

    return let(_digits(value), check)


_VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _running(numbers: Column) -> Column:
    """For each number the sum of those before it.

    Sums of runs of ``RUN`` numbers come first, so that the work for n numbers is n * RUN + (n / RUN) ** 2 small steps instead of n ** 2.
    """
    first_of = lambda x, n: total(F.slice(x, F.lit(1), n))

    def summed(runs: Column, sums: Column) -> Column:
        each = F.transform(runs, lambda run, k: let(first_of(sums, k), lambda above: F.transform(run, lambda _, i: above + first_of(run, i))))
        return F.flatten(each)

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / RUN).cast("int")), lambda k: F.slice(numbers, k * RUN + 1, F.lit(RUN)))
    return F.when(F.size(numbers) > 0, let(cut, lambda runs: let(F.transform(runs, total), lambda sums: summed(runs, sums)))).otherwise(F.array().cast("array<bigint>"))


def _located(text: Column, pattern: Column, kind: str, rank: int) -> Column:
    """Valid matches of a pattern with their places in code points: a match starts after all gaps and matches before it."""
    valid = _VALID.get(kind, lambda v: F.lit(True))

    def place(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(found, gaps, lambda m, g: (F.coalesce(F.length(m), F.lit(0)) + F.length(g)).cast("long"))

        def spans(before: Column) -> Column:
            each = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.slice(before, F.lit(1), F.size(found)).alias("b")), lambda x: x)
            made = F.transform(F.filter(each, lambda x: valid(x["m"])), lambda x: let((x["b"] + F.length(x["g"])).cast("int"), lambda at: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value"))))
            return made.cast(_SPAN)

        return F.when(F.size(found) > 0, let(_running(steps), spans)).otherwise(F.lit(None).cast(_SPAN))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: let(F.when(F.size(found) > 0, F.split(text, pattern, -1)), lambda gaps: place(found, gaps)))


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds, by start and then kind: structs of start, rank, end, kind, value. Empty for null."""

    def of(t: Column) -> Column:
        each = [
            F.coalesce(F.when(_HINTS[k](t), _located(t, F.lit(PATTERNS[k]), k, rank)), F.array().cast(_SPAN))
            for rank, k in enumerate(KINDS)
        ]
        return F.sort_array(F.concat(*each))

    return let(F.coalesce(text, F.lit("")), of)


def _terms(text: Column) -> Column:
    """Distinct lower-cased words outside all pattern matches."""
    for pattern in PATTERNS.values():
        text = F.regexp_replace(text, pattern, " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


def disclosures(docs: DataFrame, *, text_col: str = "text", prior: float = PRIOR, disclosure: float = DISCLOSURE) -> DataFrame:
    """text_key (64-bit hash), terms: for texts with protected entities, their terms that reveal one of these.

    With p over distinct texts, a term t reveals an entity e when PMI(t; e) >= ``disclosure`` * IC(e), that is
    p(e | t) >= p(e) ** (1 - ``disclosure``). Every entity is measured, those of a single text too: p(e | t) is smoothed as
    (n_te + ``prior`` * p(e)) / (n_t + ``prior``), so that few texts weigh less than many. Solved for n_t, each pair allows its term a
    largest number of texts; a term reveals something in a text when its number is within the largest that the text's entities
    allow. Nothing but these maxima is kept of the pairs.

    Entities of equal sets of texts are one, and so are terms of equal sets of texts, and a term that is in more of the entities'
    texts than any of a text's entities could allow doesn't pair up there: a page that lists thousands of entities beside
    thousands of words gives few pairs. An entity's documents are written once with their terms. A count over any part of the corpus
    is at most the count over all of it, so a term that already fails among those texts, or among them and a ``PRUNE``-th of the
    others, fails for good: only the rare rest is counted over the whole corpus. Copies of a text count once everywhere: only texts that
    have copies travel, one of each from a task, and all others are counted where they are read, so that the shuffle takes a row for each
    word that a task has seen and not one for each word of each text.
    """
    key = F.xxhash64(text_col).alias("text_key")
    found = docs.select(key, F.col(text_col).alias("text"), base_spans(F.col(text_col)).alias("spans")).filter(F.size("spans") > 0)
    entity = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], s["value"])))
    held = common.materialise(found.select("text_key", entity.alias("entities"), _terms(F.col("text")).alias("terms")), "entities")
    copied = common.materialise(docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "copied")
    texts = docs.count() - copied.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("more")).first()["more"]

    def allowed(n_te: Column, n_e: Column) -> Column:
        """The most texts that a term may have to reveal an entity."""
        share = n_e / F.lit(float(max(1, texts)))
        return (n_te + prior * share) / F.pow(share, F.lit(1 - disclosure)) - F.lit(prior)

    def sets(pairs: DataFrame, what: str, n: str) -> tuple[DataFrame, DataFrame]:
        """(what, set, n) of each member, where a set is named by its smallest member, and (text_key, set, n) of each set."""
        each = pairs.groupBy(what).agg(F.count(F.lit(1)).alias(n), F.bit_xor("text_key").alias("x"), F.bit_xor(F.xxhash64("text_key")).alias("y"))
        named = each.groupBy(n, "x", "y").agg(F.min(what).alias("set"))
        members = common.materialise(each.join(named, [n, "x", "y"]).select(what, "set", n), what)
        own = members.filter(F.col(what) == F.col("set")).select(what, n)
        return members, common.materialise(pairs.join(common.checked(own), what).select("text_key", F.col(what).alias(f"{what}_set"), n), f"{what}_sets")

    _, with_entity = sets(held.select("text_key", F.explode("entities").alias("entity")).distinct(), "entity", "n_e")
    members, uses = sets(held.select("text_key", F.explode("terms").alias("term")).distinct(), "term", "n_among")
    most = with_entity.groupBy("text_key").agg(F.max("n_e").alias("most"))
    able = uses.join(most, "text_key").filter(F.col("n_among") <= allowed(F.col("most"), F.col("most")))
    met = common.materialise(able.select("text_key", "term_set", "n_among").join(with_entity, "text_key"), "met")
    pairs = met.groupBy("term_set", "entity_set").agg(F.count(F.lit(1)).alias("n_te"), F.first("n_e").alias("n_e"), F.first("n_among").alias("n_among"))
    able_pairs = pairs.select("term_set", "entity_set", allowed(F.col("n_te"), F.col("n_e")).alias("most"), "n_among").filter(F.col("most") >= F.col("n_among")).drop("n_among")
    caps = common.materialise(met.join(able_pairs, ["term_set", "entity_set"]).groupBy("text_key", "term_set").agg(F.max("most").alias("most")), "caps")
    widest = caps.groupBy(F.col("term_set").alias("set")).agg(F.max("most").alias("most"))
    likely = common.materialise(members.join(widest, "set").select("term", "set", "n_among", "most"), "likely")

    corpus = docs.select(key, F.col(text_col).alias("text"))
    keys = common.materialise(held.select("text_key").distinct(), "keys")
    others = corpus.filter(F.pmod("text_key", F.lit(PRUNE)) == 0).join(common.checked(keys, MAX_KEYS), "text_key", "left_anti")
    seen = likely.join(_texts_with(likely, others, copied), "term", "left")
    rare = common.materialise(seen.filter(F.col("n_among") + F.coalesce("n_t", F.lit(0)) <= F.col("most")).drop("n_t"), "rare")
    counted = rare.join(_texts_with(rare, corpus, copied), "term").filter(F.col("n_t") <= F.col("most")).select("term", F.col("set").alias("term_set"), "n_t")
    revealing = caps.join(common.checked(common.materialise(counted, "counted")), "term_set").filter(F.col("n_t") <= F.col("most"))
    return revealing.groupBy("text_key").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def _texts_with(terms: DataFrame, some: DataFrame, copied: DataFrame) -> DataFrame:
    """term, n_t: the number of distinct texts (text_key, text) that have each of the ``terms``; ``copied`` has the keys of texts in several rows."""
    wanted = common.materialise(terms.select("term"), "wanted")
    twice = common.checked(copied.select("text_key"), MAX_KEYS)
    one = some.join(twice, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    once = some.join(twice, "text_key", "left_anti").select("text").unionByName(one.select("text"))
    each = once.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(common.checked(wanted), "term", "left_semi")


def find(docs: DataFrame, *, text_col: str = "text", prior: float = PRIOR, disclosure: float = DISCLOSURE, into: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """Documents (columns in ``keep``, default all) with all spans: pattern matches, and kind ``term`` for revealing terms.

    A term's spans are its occurrences, as a whole word in any case, in the texts of the entity that it reveals, outside pattern
    matches. Of these only e-mail addresses have letters, so terms are searched for in the text without their inner characters. Null
    and empty texts have none; copies of a text have equal spans; rows of any id stay; a column ``into`` of the input is replaced. A very
    long text takes time in proportion to its length, and its m matches of a kind m * 128 + (m / 128) ** 2 small steps; a text of many
    entities beside many rare terms costs their product. An empty table gives none.
    """
    columns = [c for c in (keep if keep is not None else docs.columns) if c != into]
    terms = common.materialise(disclosures(docs, text_col=text_col, prior=prior, disclosure=disclosure), "terms")
    text, key, revealing = common.fresh(docs, "text", "text_key", "terms")
    terms = terms.withColumnsRenamed({"text_key": key, "terms": revealing})
    given = docs.select(*columns, F.col(text_col).alias(text), F.xxhash64(text_col).alias(key))
    if terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS:
        joined = given.join(F.broadcast(terms), key, "left")
    else:
        keys = common.checked(terms.select(key), MAX_KEYS)
        joined = given.join(keys, key, "left_semi").join(terms, key).unionByName(given.join(keys, key, "left_anti").withColumn(revealing, F.lit(None).cast("array<string>")))

    def whole(base: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(revealing, "|"), F.lit(r")(?!\p{L})"))
        more = _located(_hollow(F.col(text)), pattern, "term", len(KINDS))
        return F.when(F.col(revealing).isNull(), base).otherwise(F.sort_array(F.concat(base, F.coalesce(more, F.array().cast(_SPAN)))))

    return joined.select(*columns, let(base_spans(F.col(text)), whole).alias(into))


def _hollow(text: Column) -> Column:
    """The text with a letter that no word has in place of each character inside an e-mail address: as long, and without its words."""
    pattern = F.lit(PATTERNS["email"])
    filled = lambda m: F.concat(F.left(m, F.lit(1)), F.repeat(F.lit(_FILLER), F.length(m) - 2), F.right(m, F.lit(1)))
    joined = lambda gaps: F.array_join(F.zip_with(gaps, F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.concat(g, F.coalesce(filled(m), F.lit("")))), "")
    return F.when(_HINTS["email"](text), let(F.split(text, pattern, -1), joined)).otherwise(text)


def sanitise(found: DataFrame, *, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Texts with every pattern match generalised to its kind in angle brackets and every revealing term removed."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        label = F.when((s["kind"] == "term") | (s["start"] < a["at"]), F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap, label).alias("out"))

    clean = F.aggregate(F.col(spans_col), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans_col) > 0, clean).otherwise(text))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document."""
    found = find(common.documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
