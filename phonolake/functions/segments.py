"""Segments of IPA text: a base letter with its modifiers, or letters under a tie bar, each one token.

The order is an automaton's: modifiers that stand before a letter, the letter, modifiers behind it, and again a letter with
modifiers behind each tie bar.  Whatever begins no segment, such as white space, punctuation or other scripts, is a token of a
single character, so the tokens of a text joined are the text.  Everything is an expression over whole texts; as another
tool's table of letters may hold more or fewer, so may its segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vocabulary import id_map

# Letters and modifiers of the published IPA chart and its extensions.
LETTERS = "abcdefghijklmnopqrstuvwxyzæçðøħŋœɐɑɒɓɔɕɖɗɘəɚɛɜɝɞɟɠɡɢɣɤɥɦɧɨɪɫɬɭɮɯɰɱɲɳɴɵɶɸɹɺɻɽɾʀʁʂʃʄʈʉʊʋʌʍʎʏʐʑʒʔʕʘʙʛʜʝʟʡʢʣʤʥʦʧʨβθχǀǁǂǃ"
BEFORE = "ᵐᶬᵑᶯ"
BEHIND = "ʰʱʲʷˠˤˀⁿˡʼ˞ːˑᶣᶹ"
TIES = "͜͡"
#: Combining marks that are no tie bars.
MARKS = "̀-͛͝-͢͠-ͯ"

_MODIFIED = f"[{LETTERS}][{BEHIND}{MARKS}]*"
#: The automaton as a pattern, the same in Java's and in RE2's syntax; a single character is the last choice.
SEGMENT = f"(?s)[{BEFORE}]*{_MODIFIED}(?:[{TIES}]{_MODIFIED})*|."



def _ranges(characters: str) -> str:
    """The characters as ranges of code points, which a pattern tests in a few steps."""
    codes = sorted(set(map(ord, characters)))
    begins = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(begins, ends, strict=True))


#: The same for Java alone: ranges, and nothing given back, as no character is in two of the classes that may follow each other.
_FAST_MODIFIED = f"[{_ranges(LETTERS)}][{_ranges(BEHIND)}{MARKS}]*+"
_FAST = f"(?s)[{_ranges(BEFORE)}]*+{_FAST_MODIFIED}(?:[{TIES}]{_FAST_MODIFIED})*+|."

PAD, UNKNOWN, BEGIN, END = "[PAD]", "[UNK]", "[BOS]", "[EOS]"
SPECIAL = (PAD, UNKNOWN)


def split(text: Column) -> Column:
    """The segments of a text; null stays null."""
    return F.regexp_extract_all(text, F.lit(_FAST), F.lit(0))


def segment_vocabulary(df: DataFrame, text: str, min_count: int = 1, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """(token, id, n): segments that occur ``min_count`` times or more, in order of their code points, behind the special tokens,
    which have no count.  The window is over distinct segments."""
    counts = df.select(F.explode(split(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    if special:
        counts = counts.where(~F.col("token").isin(*special))
    own = counts.withColumn("id", F.row_number().over(Window.orderBy("token")).cast("long") - 1 + len(special)).select("token", "id", "n")
    first = df.sparkSession.createDataFrame([(t, k, None) for k, t in enumerate(special)], "token string, id long, n long")
    return first.unionAll(own)


def as_map(vocabulary: DataFrame, most: int = 20_000) -> dict[str, int]:
    """A vocabulary of bounded size for ``encode_text`` and ``decode_ids``; a larger one is an error."""
    rows = vocabulary.select("token", "id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} tokens")
    return {r["token"]: r["id"] for r in rows}


#: Code points below this are looked up by their place in an array, all other tokens in a map, which Spark searches from its beginning.
_CODES = 1024


def encode_tokens(tokens: Column, vocabulary: dict[str, int], unknown: str = UNKNOWN) -> Column:
    """The ids of segments."""
    single = {ord(t): i for t, i in vocabulary.items() if len(t) == 1 and ord(t) < _CODES}
    others = {t: i for t, i in vocabulary.items() if len(t) != 1 or ord(t) >= _CODES}
    places = F.expr(f"array({', '.join(str(single.get(c, vocabulary[unknown])) for c in range(max(single, default=0) + 1))})")
    rest = F.lit(vocabulary[unknown])
    far = lambda t: F.coalesce(F.try_element_at(id_map(others), t), rest) if others else rest
    return F.transform(tokens, lambda t: F.when((F.length(t) == 1) & (F.ascii(t) < _CODES), F.coalesce(F.get(places, F.ascii(t)), rest)).otherwise(far(t)))


def encode_text(text: Column, vocabulary: dict[str, int], unknown: str = UNKNOWN) -> Column:
    return encode_tokens(split(text), vocabulary, unknown)


def decode_ids(ids: Column, vocabulary: dict[str, int], unknown: str = UNKNOWN, clean: bool = False) -> Column:
    """The text of ids.  An id that the vocabulary lacks is the unknown token; with ``clean`` special tokens are left out, and
    such an id is nothing."""
    left_out = {PAD, unknown, BEGIN, END} if clean else set()
    names = {i: "" if t in left_out else t for t, i in vocabulary.items()}
    lost, last = "" if clean else unknown, max(names, default=0)
    if min(names, default=0) >= 0 and last < 2 * len(names) + _CODES:  # ids are places
        table = F.array(*[F.lit(names.get(i, lost)) for i in range(last + 1)])
        found = lambda i: F.when(i.between(0, last), F.get(table, i.cast("int")))
    else:
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        found = lambda i: F.try_element_at(table, i)
    return F.array_join(F.transform(ids, lambda i: F.coalesce(found(i), F.lit(lost))), "")
