"""Licence recognition by sentence rules; DataFrame functions only, no shuffle.

Sentences are normalised (letters and digits, lower case, single spaces) and mapped to the identifiers of
known licence sentences, 0 for any other. The identifiers of a text, in order, form a sequence, on which one
ordered alternation of rules is matched from left to right: an earlier rule goes before a later one, and
what a match has used serves no other. Up to ``GAP`` unknown sentences may stand between two of a rule
(a copyright line, an address).

A text is read twice: with every line break ending a sentence (``line``), and with breaks as plain white
space but for blank lines (``wrapped``), for licence texts set in columns. A wrapped match is reported unless a line match
of the same rule lies in the same place, counted in letters and digits from the beginning of the text. A holder's
name in the third BSD clause is read as "the copyright holder"; a list of the licences covered is in the README.

Most texts hold no word that every known sentence has one of; they are left aside by one pattern, which
``_GATE`` derives from the sentences themselves.

Defined results: null and empty texts have no rows; repeated rows give repeated results; other columns are
not read. Sentence numbers count from 0 in their own reading.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions.text import let
from lineweave.llm.license_values import HOLDERS, RULES, SENTENCES

GAP = 6
LINE_END, WRAPPED_END = r"[.!?;:]+[ \t\r\n]+|\n+", r"[.!?;:]+[ \t\r\n]+|\n[ \t\r]*\n"
OTHER = "[^A-Za-z0-9]+"


def normal(sentence: str) -> str:
    return re.sub(OTHER, " ", sentence).strip().lower()


def pieces(sentence: str) -> list[str]:
    """A known sentence as the splitter leaves it: an abbreviation's stop splits it in texts, too."""
    return [p for p in (normal(x) for x in re.split(LINE_END, sentence)) if p]


# A sentence that the splitter cuts is known by its longest piece.
KNOWN = {max(pieces(text), key=len): number for number, text in SENTENCES.items()}
_WORDS = ("licens", "permission", "redistribut", "copyright", "warrant", "reserved", "mpl", "liable", "program", "reproduction", "unencumbered")
_GATE = "(?i)" + "|".join(_WORDS)
_BY_NUMBER = {n: k for k, n in KNOWN.items()}
assert all(any(w in _BY_NUMBER[n] for n in ids for w in _WORDS) for _, _, ids in RULES)


def rule_pattern(gap: int = GAP) -> str:
    """Rules over ``id@number`` items that are joined by blanks."""
    between = rf"(?: 0@[0-9]+){{0,{gap}}} "
    return "|".join(between.join(rf"\b{n}@[0-9]+" for n in ids) for _, _, ids in RULES)


def _sequence(sentences: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])

    def number(s: Column) -> Column:
        plain = F.lower(F.btrim(F.regexp_replace(s, OTHER, " ")))
        return F.try_element_at(known, F.when(F.startswith(plain, F.lit("neither the name of ")), F.regexp_replace(plain, *map(F.lit, HOLDERS))).otherwise(plain))

    return F.array_join(F.transform(sentences, lambda s, i: F.concat(
        F.coalesce(number(s), F.lit(0)).cast("string"), F.lit("@"), i.cast("string"))), " ")


def _bare(match: Column) -> Column:
    """The identifiers of a match."""
    return F.regexp_replace(F.regexp_replace(match, " 0@[0-9]+|@[0-9]+", ""), " ", ",")


def _placed(text: Column, reading: str, end: str, pattern: Column) -> Column:
    """The matches of one reading with their rule, sentences, and place in letters and digits."""
    def letters_before(sentences: Column, n: Column) -> Column:
        return F.length(F.regexp_replace(F.array_join(F.slice(sentences, F.lit(1), n), " "), OTHER, ""))

    def hit(sentences: Column, m: Column) -> Column:
        first = F.regexp_extract(m, "@([0-9]+)", 1).cast("int")
        last = F.regexp_extract(m, "@([0-9]+)$", 1).cast("int")
        return F.struct(F.lit(reading).alias("reading"), _bare(m).alias("ids"), first.alias("first"), last.alias("last"),
                        letters_before(sentences, first).alias("begin"), letters_before(sentences, last + 1).alias("end"))

    return let(F.split(text, end), lambda sentences: F.transform(
        F.regexp_extract_all(_sequence(sentences), pattern, F.lit(0)), lambda m: hit(sentences, m)))


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """One row a match: ``id_col, license, kind, reading, first_sentence, last_sentence, sentence_ids``."""
    text = F.col(f"`{text_col}`")
    pattern = F.lit(rule_pattern(gap))
    rules = F.create_map(*[x for name, kind, ids in RULES for x in (
        F.lit(",".join(map(str, ids))), F.struct(F.lit(name).alias("license"), F.lit(kind).alias("kind")))])
    read = docs.filter(text.rlike(_GATE)).select(
        F.col(f"`{id_col}`").alias(id_col), _placed(text, "line", LINE_END, pattern).alias("_line"),
        _placed(text, "wrapped", WRAPPED_END, pattern).alias("_wrapped"))
    again = F.filter("_wrapped", lambda w: ~F.exists("_line", lambda x: (
        x["ids"] == w["ids"]) & (x["begin"] < w["end"]) & (w["begin"] < x["end"])))
    hit = read.select(id_col, F.explode(F.concat("_line", again)).alias("_hit")).select(id_col, "_hit.*")
    return hit.select(
        id_col, rules[F.col("ids")]["license"].alias("license"), rules[F.col("ids")]["kind"].alias("kind"), "reading",
        F.col("first").alias("first_sentence"), F.col("last").alias("last_sentence"), F.col("ids").alias("sentence_ids"))
