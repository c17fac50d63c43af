"""Rows, prompts and judgements as text, by Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names that columns of benchmark rows go by, in order of preference; a rubric's criteria; parts of secrets' names.
ID_NAMES = ("id", "key", "audio_id", "question_id", "uid", "index")
QUESTION_NAMES = ("question", "instruction", "prompt", "text")
CHOICE_NAMES = ("choices", "options", "answer_choices")
CHOICE_LETTERS = "abcdef"
AUDIO_NAMES = ("audios", "audio_paths", "audio", "context", "audio_path", "audio_file", "path", "audio_id")
AUDIO_SUFFIXES = (".wav", ".flac", ".mp3", ".ogg")
CRITERIA = ("correctness", "relevance", "completeness", "clarity")
SECRET_NAMES = ("token", "secret", "password", "key")
ANSWER_WITH = "Respond with the choice letter followed by the choice text."
# Fixed value: what stands for a secret.
REDACTED = "<redacted>"
# The characters that are white space at a text's ends.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(value: Column) -> Column:
    """value without the white space, of any kind, at its ends."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def blank_to_null(value: Column) -> Column:
    return F.nullif(stripped(value.cast("string")), F.lit(""))


def words(text: Column) -> Column:
    """Runs of what isn't white space: the length of a text where there is no tokenizer."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("(\\S+)"))), F.lit(0)).cast("long")


def first_text(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of these columns that is there and not blank, trimmed; else empty."""
    there = [blank_to_null(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(""))


def choices(df: DataFrame) -> Column:
    """Choices of a benchmark row: the first list or map that is there, even if empty, without blanks; else choice_a to choice_f."""

    def not_blank(x: Column) -> Column:
        return stripped(x) != ""

    lists = []
    for n in CHOICE_NAMES:
        if n in df.columns:
            kind = df.schema[n].dataType
            if isinstance(kind, T.MapType):
                lists.append(F.filter(F.map_values(F.col(n)).cast("array<string>"), not_blank))
            elif isinstance(kind, T.ArrayType):
                lists.append(F.filter(F.col(n).cast("array<string>"), not_blank))
    single = [F.col(f"choice_{x}").cast("string") for x in CHOICE_LETTERS if f"choice_{x}" in df.columns]
    last = F.filter(F.array(*single), lambda x: x.isNotNull() & not_blank(x)) if single else F.array().cast("array<string>")
    return F.coalesce(*lists, last)


def audio_paths(df: DataFrame) -> Column:
    """Audio of a benchmark row, in order: the first usable column; audio_id only if it ends as a file does. Null if there is none."""
    found = []
    for n in AUDIO_NAMES:
        if n not in df.columns:
            continue
        kind = df.schema[n].dataType
        if isinstance(kind, T.ArrayType):
            found.append(F.when(F.size(F.col(n)) > 0, F.col(n).cast("array<string>")))
        elif isinstance(kind, T.StructType):
            found.append(F.when(F.col(n).isNotNull(), F.array(F.col(f"{n}.path"))))
        else:
            value = F.col(n).cast("string")
            usable = value.isNotNull()
            if n == "audio_id":
                usable &= reduce(lambda a, b: a | b, (F.lower(value).endswith(x) for x in AUDIO_SUFFIXES))
            found.append(F.when(usable, F.array(value)))
    return F.coalesce(*found, F.lit(None).cast("array<string>"))


def with_choices(question: Column, options: Column) -> Column:
    """A question, trimmed, with its options, if any, as lettered lines and how to answer."""
    lines = F.array_join(F.transform(options, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c)), "\n")
    asked = stripped(question)
    return F.when(F.size(options) > 0, F.concat(asked, F.lit("\n\nChoices:\n"), lines, F.lit(f"\n\n{ANSWER_WITH}"))).otherwise(asked)


def messages(*parts: tuple[str, Column]) -> Column:
    """Chat messages; a blank one is refused."""

    def checked(role: str, text: Column) -> Column:
        return F.when(stripped(text) != "", text).otherwise(F.raise_error(F.lit(f"the {role} message is blank")))

    return F.array(*(F.struct(F.lit(role).alias("role"), checked(role, text).alias("content")) for role, text in parts))


def around(rendered: Column, sentinel: str) -> Column:
    """What stands before and after a sentinel that occurs once; null otherwise."""
    parts = F.split(rendered, _quoted(sentinel))
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("before"), parts[1].alias("after")))


def occurrences(text: Column, part: str) -> Column:
    """How often a part occurs."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def leaks_instruction(prompt: Column, instruction: str, sentinel: str) -> Column:
    """Whether a prompt holds an instruction that it must not, or not exactly one sentinel."""
    return prompt.contains(instruction) | (occurrences(prompt, sentinel) != 1)


def _quoted(part: str) -> str:
    return "\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def placed_choices(df: DataFrame, key: list[str], choices_of: str) -> DataFrame:
    """Choices of all rows in one column, a row each: key, place, choice, and n_choices, so that place 0 begins a row's slice."""
    return df.select(*key, F.size(choices_of).alias("n_choices"), F.posexplode(choices_of).alias("place", "choice"))


def split_ids(ids: Column, offsets: Column, at: Column) -> Column:
    """Ids before and from a character, by their offsets (structs of begin and end); null if one crosses it."""
    pairs = F.arrays_zip(ids.alias("id"), offsets.alias("span"))
    crossing = F.exists(offsets, lambda s: (s["begin"] < at) & (s["end"] > at))
    before = F.transform(F.filter(pairs, lambda p: p["span"]["end"] <= at), lambda p: p["id"])
    after = F.transform(F.filter(pairs, lambda p: p["span"]["end"] > at), lambda p: p["id"])
    return F.when(~crossing, F.struct(before.alias("before"), after.alias("after")))


def without_end(ids: Column, end: int) -> Column:
    """ids without a last one that is the end id."""
    return F.when(F.try_element_at(ids, F.lit(-1)) == end, F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)


def option_letter(answer: Column) -> Column:
    """The letter A to D that an answer begins with, or has just before its end; null if there is none."""
    p = F.replace(stripped(answer), F.lit("\n"), F.lit(""))
    first, late = F.substring(p, 1, 1), F.when(F.length(p) > 1, F.substring(p, -2, 1))
    usable = p.isNotNull() & (p != "None")
    return F.when(usable, F.when(first.rlike("^[A-D]$"), first).when(late.rlike("^[A-D]$"), late))


def rating(value: Column) -> Column:
    """A rating from 1 to 5: a number, or the first in double brackets; 0 otherwise."""
    number = value.try_cast("double")
    within = F.when((number >= 1) & (number <= 5), number).otherwise(0.0)
    marked = F.nullif(F.regexp_extract(value, r"\[\[([0-9]+)\]\]", 1), F.lit("")).try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), within).when((marked >= 1) & (marked <= 5), marked), F.lit(0.0))


def rubric(text: Column) -> Column:
    """Scores by criterion and overall; a missing criterion is 0, a missing overall score the mean of the criteria."""

    def score(name: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"(?i){name}\s*:\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")

    each = {c: F.coalesce(score(c), F.lit(0.0)) for c in CRITERIA}
    mean = reduce(lambda a, b: a + b, each.values()) / len(each)
    return F.struct(*(v.alias(k) for k, v in each.items()), F.coalesce(score("overall"), mean).alias("overall"))


def yes_wins(votes: Column) -> Column:
    """Whether more votes are yes than no."""

    def n(x: str) -> Column:
        return F.size(F.filter(votes, lambda v: F.lower(stripped(v)) == x))

    return F.coalesce(n("yes") > n("no"), F.lit(False))


def redacted(df: DataFrame) -> DataFrame:
    """df with columns whose names speak of secrets blotted out."""
    return df.withColumns({c: F.lit(REDACTED) for c in df.columns if any(x in c.lower() for x in SECRET_NAMES)})
