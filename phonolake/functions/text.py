"""String functions as column expressions.  Only Unicode decomposition, which Spark lacks, runs in Python, and only for
rows that hold a character that may decompose."""

from __future__ import annotations

import mimetypes
import string
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRESS = "ˈˌ"
#: Ranges outside which no character has a canonical decomposition or a combining class.
_MAY_DECOMPOSE = (
    r"[\u00C0-\u024F\u0300-\u036F\u0374-\u0390\u03AA-\u03D4\u0400-\u0487\u04C1-\u04F9\u0591-\uABED\uAC00-\uD7A3\uF900-\uFFFF]"
    r"|[^\u0000-\uFFFF]"
)
#: White space as Python's str.isspace() has it.
PY_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@F.pandas_udf(T.StringType())
def _nfd(s: pd.Series) -> pd.Series:
    """Of single batches, not of an iterator: Spark then asks one worker for several columns."""
    return s.map(lambda x: unicodedata.normalize("NFD", x), na_action="ignore")


def nfd(text: Column) -> Column:
    """Canonical decomposition.  Other rows pass null to Python and keep their text."""
    return F.coalesce(_nfd(F.when(text.rlike(_MAY_DECOMPOSE), text)), text)


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def without_characters(text: Column, drop: str) -> Column:
    return F.translate(text, drop, "")


def clean_text(text: Column, keep_space: bool = False, decompose: bool = True) -> Column:
    """Drops spaces, ASCII punctuation and stress marks; decomposes; writes g and rhotic vowels in one way."""
    out = without_characters(text, string.punctuation + STRESS + ("" if keep_space else " "))
    out = nfd(out) if decompose else out
    for old, new in (("g", "ɡ"), ("ɚ", "ə˞"), ("ɝ", "ɜ˞")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return strip_space(out)


def clean_token(text: Column) -> Column:
    return clean_text(text, keep_space=True)


def clean_response(text: Column, fix_g: bool = True, fix_rhotics: bool = False) -> Column:
    """A language model's answer without white space and punctuation; the variants differ in the last two rewrites."""
    out = F.regexp_replace(text, PY_SPACE, "")
    out = nfd(without_characters(out, string.punctuation))
    if fix_g:
        out = F.replace(out, F.lit("g"), F.lit("ɡ"))
    if fix_rhotics:
        out = F.replace(F.replace(out, F.lit("ɚ"), F.lit("ə˞")), F.lit("ɝ"), F.lit("ɜ˞"))
    return out


def tokens(text: Column) -> Column:
    """The text split at white space; no empty tokens."""
    return F.filter(F.split(text, f"{PY_SPACE}+"), lambda x: x != "")


def rejoined_fields(line: Column) -> tuple[Column, Column]:
    """Key and the rest joined by single spaces; the rest is null where there is none."""
    parts = tokens(line)
    rest = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), " "))
    return F.get(parts, F.lit(0)), rest


def key_and_rest(line: Column) -> tuple[Column, Column]:
    """Key and the rest with its inner spacing; a key alone has the empty rest."""
    bare = strip_space(line)
    return F.regexp_extract(bare, r"(?s)^(\S+)\s*(.*)$", 1), F.regexp_extract(bare, r"(?s)^(\S+)\s*(.*)$", 2)


def language_of(tag: Column) -> Column:
    """``<eng><test>`` is eng.  A single tag keeps its closing bracket, as files in use rely on it."""
    head = F.get(F.split(tag, "><"), F.lit(0))
    return strip_space(F.substring(head, 2, 1_000_000))


def thought_split(text: Column) -> tuple[Column, Column]:
    """(answer, thought) of a response with a <think> block: the answer is what stands before and after it; in an
    unclosed block everything behind the opening tag is thought; without a block the thought is empty."""
    opened = text.contains("<think>")
    before = F.when(opened, F.substring_index(text, "<think>", 1)).otherwise(text)
    rest = F.when(opened, F.regexp_extract(text, r"(?s)<think>(.*)$", 1)).otherwise("")
    thought = F.substring_index(rest, "</think>", 1)
    after = F.regexp_extract(rest, r"(?s)</think>(.*)$", 1)
    return strip_space(F.concat(before, after)), strip_space(thought)


def ctc_collapse(ids: Column, blank: Column | int | str) -> Column:
    """Runs of one element become one, then blanks go; a blank between equals keeps both."""
    blank = blank if isinstance(blank, Column) else F.lit(blank)
    return F.filter(ids, lambda x, i: (x != blank) & ((i == 0) | ~x.eqNullSafe(F.get(ids, i - 1))))


def last_segment(text: Column, mark: str = ">") -> Column:
    return F.element_at(F.split(text, mark), -1)


def without_special(items: Column, special: list[str]) -> Column:
    return F.filter(items, lambda x: ~x.isin(special))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"[-+]?\d+(?:\.\d+)?", 0)


def coordinate(text: Column) -> Column:
    """The first number in a text such as ``23.5 S``, negated if a capital S or W stands anywhere; null without one."""
    number = F.regexp_extract(text, r"[-+]?\d+(?:\.\d+)?", 0)
    value = F.when(number != "", number.cast("double"))
    return F.when(text.rlike("[SW]"), -value).otherwise(value)


def six_digits(text: Column) -> Column:
    found = F.regexp_extract(text, r"(\d{6})", 1)
    return F.when(found != "", found)


def mime_type(path: Column) -> Column:
    """By suffix, as Python's table of types has it; unknown files are octets."""
    suffixes = ("wav", "wave", "mp3", "flac", "ogg", "m4a", "aac", "aiff", "opus", "mp4", "json", "txt")
    known = {s: mimetypes.guess_type(f"x.{s}", strict=False)[0] for s in suffixes}
    known |= {s: known[s] or kind for s, kind in (("wav", "audio/wav"), ("wave", "audio/wav"), ("flac", "audio/flac"), ("mp3", "audio/mpeg"))}
    table = F.create_map(*[F.lit(x) for kv in known.items() if kv[1] for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def render_template(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` fields replaced by columns, null by the empty text; a field without a column is an error."""
    parts: list[Column] = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in values:
                raise KeyError(f"the template needs a value for {field!r}")
            parts.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def json_or_raw(text: Column, key: str) -> Column:
    """The value of ``key`` in a JSON text, else the text itself."""
    return F.coalesce(F.get_json_object(text, f"$.{key}"), text)


def json_in_braces(text: Column) -> Column:
    """From the first opening to the last closing brace, for answers with words around the JSON."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def json_answer(text: Column, key: str) -> Column:
    """The value of ``key`` in the JSON object that the text holds, else that object, else the text."""
    held = F.coalesce(json_in_braces(text), text)
    return F.coalesce(F.try_variant_get(F.try_parse_json(held), f"$.{key}", "string"), held)


#: How models say that they got no audio.
NO_AUDIO = (
    r"\bno audio\b",
    r"\baudio (?:clip|file|input )?(?:was )?not provided\b",
    r"\bno playable audio\b",
    r"\bprovide (?:the |an )?audio\b",
    r"\battach (?:the |an )?audio\b",
    r"\bwithout hearing it\b",
    r"\bcannot transcribe provided content\b",
    r"\bcan't transcribe (?:it|the audio).*(?:without|because no)",
    r"\bcan’t transcribe (?:it|the audio).*(?:without|because no)",
)


def says_no_audio(text: Column) -> Column:
    """Whether a model answers that it got no audio."""
    return F.regexp_replace(F.lower(text), r"\s+", " ").rlike("|".join(f"(?:{p})" for p in NO_AUDIO))


def reported_mean(text: Column) -> Column:
    r"""The mean of a cell such as ``\ms{85.2}{1.3}`` or ``85.2``; null without a number."""
    pattern = r"\\ms\s*\{([-\d.]+)\}|([-\d.]+)"
    first, bare = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(first != "", first).when(bare != "", bare).try_cast("double")


def reported_name(text: Column) -> Column:
    """A row's name without its markup commands."""
    return strip_space(F.regexp_replace(text, r"\\[a-zA-Z]+\{|[}\\]", ""))


def code_points(text: Column) -> Column:
    """``U+0061 U+0062`` of a text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.format_string("U+%04X", F.ascii(c))), " ")


@F.pandas_udf(T.StringType())
def unicode_names(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``char: NAME`` of a text's characters, by semicolons."""
    for s in parts:
        yield s.map(lambda x: "; ".join(f"{c}: {unicodedata.name(c, 'UNNAMED')}" for c in x), na_action="ignore")


def result_text(response: Column) -> Column:
    """Text of a batch API's response: text, output_text, or the parts of its candidates."""
    parts = F.flatten(F.transform(response["candidates"], lambda c: c["content"]["parts"]["text"]))
    return F.coalesce(response["text"], response["output_text"], F.array_join(parts, ""))


def conversation_of_path(path: Column, mark: str = "_") -> Column:
    """What stands before the first mark of the file's name."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.substring_index(name, mark, 1)


def run_tag(moment: Column) -> Column:
    """A run's tag, such as 20240131_235959."""
    return F.date_format(moment, "yyyyMMdd_HHmmss")


def best_phonemes(response: Column) -> Column:
    """The phonemes of the best hypothesis of an assessment in JSON, word by word and joined by spaces; empty without any."""
    words = F.from_json(F.get_json_object(response, "$.NBest[0].Words"), "array<struct<Phonemes: array<struct<Phoneme: string>>>>")
    return F.coalesce(F.array_join(F.flatten(F.transform(words, lambda w: F.coalesce(w["Phonemes"]["Phoneme"], F.array().cast("array<string>")))), " "), F.lit(""))


def speaker_of_path(path: Column) -> Column:
    """The folder that holds the file."""
    return F.element_at(F.split(F.regexp_replace(path, r"/[^/]*$", ""), "/"), -1)
