"""Text expressions: cleaning, titles, tokens, prompts, and what is read out of model replies.

Java's regular expressions recurse over repeated groups and look for a match from every place of a long run. So repeated
groups are possessive here (``*+``), and runs are entered only at their beginning (a look back): no text, however long,
overflows a stack or takes time that grows with the square of its length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Control characters that cleaning removes; a table-of-contents line; the default title pattern.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CONTENTS_LINE = r"(?<!\.\s{0,1})(?:\.\s?){4,}+\s*+\d++\s*+$|(?<!…)…++\s*+\d++\s*+$"
TITLE = r"^(\d+(\.\d+){0,3})\s+[A-ZÁÉÍÓÚÂÊÔÃÕÇ][^\n]{2,80}$"
# Words that answer comparison ignores.
LITTLE_WORDS = "o a os as um uma uns umas de do da dos das em no na nos nas por para com ao à aos às e".split()

#: White space as Python's str.split() has it; a word character.
SPACE = r"[\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
SPACES = SPACE + "+"
WORD = r"[\p{L}\p{N}_]"


# All that canonical composition may change, and some beside: marks, finals of Korean syllables, and the
# blocks that hold characters which it replaces. Nothing below U+0300 is among them.
UNCOMPOSED = (
    r"[\p{M}\x{374}\x{37e}\x{387}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a5e}\x{b5c}-\x{b5d}\x{f43}-\x{fb9}\x{1161}-\x{11c2}"
    r"\x{1f71}-\x{2001}\x{2126}-\x{212b}\x{2329}-\x{232a}\x{2adc}\x{f900}-\x{fb4e}\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1d}]"
)


def _normalised(text: Column, form: str, compatible: bool) -> Column:
    """``compose`` or ``decompose`` by the Unicode library that Spark itself uses for collations; not for nulls."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(form), text, F.lit(compatible))


def composed(text: Column) -> Column:
    """The text in canonical composition. Only texts that it may change are looked at further."""
    return F.when(text.rlike(r"[\x{300}-\x{10ffff}]") & text.rlike(UNCOMPOSED), _normalised(text, "compose", False)).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{SPACE}++|{SPACE}(?<!{SPACE}{{2}}){SPACE}*+$", "")


def words(text: Column) -> Column:
    """The array of words between white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repetition_key(text: Column) -> Column:
    """What repeats of a header or footer have in common: the text without digits, spaces collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"\p{Nd}", ""), SPACES, " "))


def clean(text: Column, compose: bool = False) -> Column:
    """Block text made plain: ligatures, line ends, hyphenation and single breaks undone; paragraphs keep a blank line.

    compose: also canonical composition, for texts that weren't composed before.
    """
    t = composed(text) if compose else text
    for a, b in LIGATURES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x{a0}\t]", " ")
    t = F.regexp_replace(t, r"\x{ad}\n?", "")
    t = F.regexp_replace(t, CONTROL, "")
    t = F.regexp_replace(t, rf"({WORD})-[ ]*+\n[ ]*+(?=[a-zà-öø-ÿ])", "$1")
    t = F.regexp_replace(t, rf"(?<={WORD})/[ ]*+\n[ ]*+(?={WORD})", "/")
    parts = F.transform(F.split(t, r"\n[ ]*\n"), lambda p: strip(F.regexp_replace(F.regexp_replace(p, r"(?<! )[ ]*+\n[ ]*+", " "), r" {2,}+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def is_contents_line(line: Column) -> Column:
    return line.rlike(CONTENTS_LINE)


def title_number(line: Column, pattern: str = TITLE) -> Column:
    """The numbering of a title line, null for other lines."""
    t = strip(line)
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1))


def numbering(number: Column) -> Column:
    """"4.2" -> [4, 2]; parts that aren't numbers are left out."""
    return F.transform(F.filter(F.split(number, r"\."), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))


def title_follows(new: Column, current: Column, jump: int = 5) -> Column:
    """Whether section ``new`` may come after ``current`` (arrays of numbers; null or empty current: any may).

    At the first level that differs the number grows by 1 to ``jump``, or new goes deeper than all of current; the
    levels that open below lie in 1 to ``jump``. Repeats of the current section or of one above it don't follow.
    """
    depth = F.least(F.size(new), F.size(current))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(depth, F.lit(1))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (i <= depth) & (F.get(new, i - 1) == F.get(current, i - 1)), i).otherwise(n),
    )
    step = F.get(new, same) - F.get(current, same)
    inner = same < F.size(current)
    opened = F.slice(new, F.when(inner, same + 2).otherwise(same + 1), F.size(new))
    fits = F.forall(opened, lambda x: x.between(1, jump))
    rule = F.when(F.size(new) == 0, False).when(same == F.size(new), False).when(inner & ~step.between(1, jump), False).otherwise(fits)
    return F.when(current.isNull() | (F.size(current) == 0), True).otherwise(rule)


def without_thinking(text: Column) -> Column:
    """A reply without <think> blocks, closed or not; what precedes a lone closing tag goes too."""
    t = F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|$)\s*", "")
    cut = F.when(F.contains(t, F.lit("</think>")), F.substring(t, F.locate("</think>", t) + len("</think>"), F.length(t))).otherwise(t)
    return F.when(text.rlike("</?think>"), cut).otherwise(text)


@lru_cache(maxsize=1)
def combining_marks() -> str:
    """A pattern for the characters that combine with the one before them, from their classes."""
    marks = [c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    begins = [c for c in marks if not unicodedata.combining(chr(c - 1))]
    ends = [c for c in marks if not unicodedata.combining(chr(c + 1))]
    # Java tries the ranges of a class one by one: all but a few characters fail the first
    return r"[\x{300}-\x{1efff}&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(begins, ends, strict=True)) + "]]+"


def without_accents(text: Column) -> Column:
    """Compatible forms (ﬁ, ³) made plain, letters taken apart, and their marks removed, in any script."""
    plain = F.regexp_replace(_normalised(text, "decompose", True), combining_marks(), "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), plain).otherwise(text)


@lru_cache(maxsize=1)
def portuguese_stop_words() -> tuple[str, ...]:
    """Spark's own list; needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("portuguese"))


def lowered(text: Column) -> Column:
    """Composed, in lower case."""
    # as lower(composed(text)); a lower(text) beside it is made once for both
    return F.when(text.rlike(r"[\x{300}-\x{10ffff}]") & text.rlike(UNCOMPOSED), F.lower(_normalised(text, "compose", False))).otherwise(F.lower(text))


def spaced(text: Column, keep_accents: bool = True) -> Column:
    """Composed, in lower case, with a space for each character beyond ASCII that is no letter or digit. What lies between
    spaces and others of ASCII than letters and digits is ``tokens``, if it isn't too short."""
    t = lowered(text)
    return F.regexp_replace(t if keep_accents else without_accents(t), r"[^\x00-\x7f\p{L}\p{N}]", " ")


def left_out(stop_words: Sequence[str], keep_accents: bool = True) -> list[str]:
    """Stop words in the form in which tokens are."""
    if keep_accents:
        return list(stop_words)
    return ["".join(x for x in unicodedata.normalize("NFKD", w) if not unicodedata.combining(x)) for w in stop_words]


def tokens(text: Column, stop_words: Sequence[str] = (), keep_accents: bool = True) -> Column:
    """Lower-case runs of letters and digits of two characters or more, without stop words; accents as composed."""
    t, stops = F.lower(composed(text)), left_out(stop_words, keep_accents)
    found = F.filter(F.split(t if keep_accents else without_accents(t), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    return F.filter(found, lambda w: ~w.isin(stops)) if stops else found


def token_estimate(n_words: Column, per_word: float = 1.3) -> Column:
    """Model tokens of so many words, at least one; halves round to even."""
    return F.greatest(F.lit(1), F.bround(n_words * F.lit(float(per_word))).cast("int"))


def answer_text(text: Column) -> Column:
    """An answer as compared: composed, lower case, no separators within numbers, no punctuation, no little words."""
    t = F.regexp_replace(F.lower(composed(text)), r"[.,](?<=\p{Nd}.)(?=\p{Nd})", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\s\x{85}\x{a0}\p{Z}]|_", " ")
    return F.array_join(F.filter(words(t), lambda w: ~w.isin(LITTLE_WORDS)), " ")


def abstention_text(text: Column) -> Column:
    t = F.regexp_replace(without_accents(F.lower(text)), r"[^\p{L}\p{N}_\s\p{Z}]", " ")
    return strip(F.regexp_replace(t, SPACES, " "))


def abstains(reply: Column, phrase: Column) -> Column:
    """Whether the reply contains the phrase, regardless of case, accents and punctuation."""
    target = abstention_text(phrase)
    return (target != "") & F.contains(abstention_text(reply), target)


# The forms of citations. Section, page, both, and parentheses that hold one.
SECTION = r"se[çc][ãa]o\s*+(?:\{\s*+)?+(\d++(?:\.\d++)*+)\s*+\}?+"
PAGE = r"(?:p\.|p[áa]g\.?|p[áa]gina)\s*+(?:\{\s*+)?+(\d++)\s*+\}?+"
PAIR = SECTION + r"\s*+(?:[,;–-]\s*+)?+" + PAGE
IN_PARENTHESES = r"\((?=[^()]*+\))[^()]*?(?:se[çc][ãa]o|\bp\.|\bp[áa]g)[^()]*+\)"


def citations(reply: Column) -> Column:
    """The array of (section, page) cited, in order; what is missing of a pair is null."""
    section, page = SECTION.replace(r"(\d++(?:", r"(?:\d++(?:"), PAGE.replace(r"(\d++)", r"\d++")
    pair = section + r"\s*+(?:[,;–-]\s*+)?+" + page
    found = F.regexp_extract_all(reply, F.lit(rf"(?iu)((?:{pair})|(?:{section})|(?:(?<![\p{{L}}\p{{N}}_.]){page}))"), F.lit(1))

    def fields(c: Column) -> Column:
        own = F.regexp_extract(c, rf"(?iu){SECTION}", 1)
        rest = F.regexp_replace(c, rf"(?iu){SECTION}", "")
        at = F.regexp_extract(rest, r"(\d+)", 1)
        return F.struct(F.when(own != "", own).alias("section"), at.try_cast("int").alias("page"))

    return F.transform(found, fields)


def without_citations(reply: Column) -> Column:
    """The reply without its citations, as it is compared with a reference answer."""
    t = F.regexp_replace(reply, rf"(?iu){IN_PARENTHESES}", " ")
    t = F.regexp_replace(t, rf"(?iu){PAIR}", " ")
    t = F.regexp_replace(t, r"(?U)(?<!\s)\s++([.,;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s{2,}+", " "), r"^[ \n\-–]++|(?<![ \n\-–])[ \n\-–]++$", "")


def cites(citation: Column, section: Column, first_page: Column, last_page: Column) -> Column:
    """Whether a citation fits a chunk: its section if named, its page within the chunk's if named; one must be."""
    named = citation["section"].isNotNull() | citation["page"].isNotNull()
    fits = (citation["section"].isNull() | (citation["section"] == section)) & (citation["page"].isNull() | citation["page"].between(first_page, last_page))
    return named & fits


def json_object(text: Column, schema: str) -> Column:
    """The object between the first and the last brace of a text, by schema; null where there is none or it is broken."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substring(text, first, last - first + 1)).otherwise("")
    # as an array's only element: what follows the object is otherwise passed over
    listed = F.try_parse_json(F.concat(F.lit("["), found, F.lit("]")))
    whole = (found != "") & listed.isNotNull() & F.try_variant_get(listed, "$[1]", "string").isNull()
    return F.when(whole, F.from_json(found, schema))


def evidence_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(t\d+)"), F.lit(1))


def section_label(section_id: Column, section: Column) -> Column:
    return F.when(F.coalesce(section_id, F.lit("")) != "", section_id).otherwise(section)


def context(chunks: Column) -> Column:
    """An array of chunks (section_id, section, page_start, text) as numbered passages for a prompt."""
    one = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (seção "), section_label(c["section_id"], c["section"]), F.lit(", p. "), c["page_start"].cast("string"), F.lit(") "), c["text"])
    return F.array_join(F.transform(chunks, one), "\n\n")


def fill(template: str, **fields: Column) -> Column:
    """A template with {name} fields; {{ and }} are braces. A field that isn't given, or isn't there, is an error."""
    import string

    parts, seen = [], set()
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in fields:
                raise KeyError(f"field {name!r} of the template has no value")
            seen.add(name)
            parts.append(fields[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")
