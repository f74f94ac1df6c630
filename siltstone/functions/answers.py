"""Strict parsing of multiple-choice answers as one Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_ASCII, final_section, headings_in_order, let, nfkc, nfkc_all, short_answer, strip

#: The marker before an answer letter, a boxed letter, a lone letter, and answers in words.
MARKER = r"(?i)(?:final\s+answer|answer)\s*(?:is\s*)?[:=\-]?\s*[\(\[]?([A-Za-z])[\)\]]?(?=\s|$|[.,;])"
BOXED = r"\\boxed\s*\{\s*([A-Za-z])\s*\}"
LONE = r"^\s*[\(\[]?([A-Za-z])[\)\].]?\s*$"
IN_WORDS = {"yes": "A", "no": "B", "maybe": "C"}


def parse(text: Column, options: Column, protocol: Column, *, compatibility: bool = True) -> Column:
    """struct(parsed_answer, parse_method, parse_success, ambiguous, format_valid).

    ``options``: array of struct(key, value). The first of these that applies decides: the last allowed letter after a marker in
    the final section, the last allowed boxed letter, a section of one allowed letter, a section that is yes, no or maybe, a
    section equal to exactly one option's text. Nothing is guessed. The last two compare short answers, in the NFKC form where a
    section or an option isn't all ASCII (``compatibility``; without it the expression stays in the JVM).
    """
    raw = strip(F.coalesce(text, F.lit("None")))
    no = F.lit(None).cast("string")
    keys, values = F.transform(options, lambda o: F.upper(o["key"])), F.transform(options, lambda o: o["value"])
    formed, forms = no, F.lit(None).cast("array<string>")
    if compatibility:  # outside of the lambdas, which Python functions can't enter; null where the text itself will do
        formed = nfkc(F.when(final_section(raw).rlike(NOT_ASCII), final_section(raw)))
        forms = nfkc_all(F.when(F.array_join(values, "").rlike(NOT_ASCII), values))

    def read(given: Column) -> Column:
        x, allowed = given["raw"], given["keys"]
        valid = F.when(protocol == "cot", headings_in_order(x)).otherwise(F.lit(True))

        def letters(pattern: str, where: Column) -> Column:
            found = F.transform(F.regexp_extract_all(where, F.lit(pattern), F.lit(1)), lambda a: F.upper(a))
            return F.filter(found, lambda a: F.array_contains(allowed, a))

        def result(answer: Column, method: str, ambiguous: Column) -> Column:
            return F.struct(answer.alias("parsed_answer"), F.lit(method).alias("parse_method"), F.lit(True).alias("parse_success"), ambiguous.alias("ambiguous"), valid.alias("format_valid"))

        last = lambda a: F.try_element_at(a, F.lit(-1))
        several = lambda a: F.size(F.array_distinct(a)) > 1
        words = F.create_map(*[F.lit(v) for pair in IN_WORDS.items() for v in pair])

        def by_text(section: Column, short: Column) -> Column:
            in_words = F.try_element_at(words, short)
            equal = F.filter(F.arrays_zip(allowed.alias("k"), F.coalesce(given["forms"], given["values"]).alias("v")), lambda o: short_answer(o["v"]) == short)
            return let(F.transform(equal, lambda o: o["k"]), lambda same: (
                F.when(F.array_contains(allowed, in_words), result(in_words, "pubmed_semantic", F.lit(False)))
                .when(F.size(same) == 1, result(last(same), "exact_option_text", F.lit(False)))
                .otherwise(F.struct(no.alias("parsed_answer"), no.alias("parse_method"), F.lit(False).alias("parse_success"), (F.size(same) > 1).alias("ambiguous"), F.lit(False).alias("format_valid")))
            ))

        def by_letter(section: Column, plain: Column) -> Column:
            lone = F.upper(F.regexp_extract(plain, LONE, 1))
            return let(letters(MARKER, plain), lambda marked: F.when(F.size(marked) > 0, result(last(marked), "final_answer_marker", several(marked))).otherwise(
                let(letters(BOXED, section), lambda boxed: F.when(F.size(boxed) > 0, result(last(boxed), "boxed_letter", several(boxed)))
                .when(F.array_contains(allowed, lone), result(lone, "single_letter", F.lit(False)))
                .otherwise(let(short_answer(F.coalesce(given["formed"], section)), lambda short: by_text(section, short))))
            ))

        return let(final_section(x), lambda section: let(F.regexp_replace(section, r"[*_`]", ""), lambda plain: by_letter(section, plain)))

    return let(F.struct(raw.alias("raw"), keys.alias("keys"), values.alias("values"), formed.alias("formed"), forms.alias("forms")), read)
