"""Quality rules, line first: bad lines go, then documents that lost too much text or fail the base rules are rejected.

Everything is one pass of expressions over each row; nothing is shuffled, so no key can be hot.

Each line is judged by itself.  It is removed if it

* does not end in closing punctuation of any script (punctuation rule),
* holds many symbol characters or shouts with repeated exclamation marks (symbol rule),
* holds several menu separators, or is an entry of a menu and nothing else (navigation rule), or
* is a licence, copyright, cookie or script notice in English, French, German or Spanish (boilerplate rule).

A line is a paragraph, and a long one is not lost for its end or for a phrase in it: the punctuation and boilerplate rules
fail only lines shorter than ``LONG_LINE`` and lines without any end of a sentence.  ``long_lines=False`` has them fail
lines of any length, by Latin marks alone; that is what the SQL of ``op4_quality_rules`` states.

A document is kept if it passes the base rules and its removed lines hold at most ``max_lost`` of its characters.

Repeated three-word windows are found in two steps: 43 bits of each window's hash and its position are packed into one
long and sorted, which finds every candidate; candidates are then compared as text, so a chance collision of hashes
cannot change a count.

Defined results: null text has no words, counts zero and is rejected; an empty document likewise; repeated rows are
judged one by one; very long texts are read whole; an empty table gives an empty one; columns named like an output are
replaced, others stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, Boxed, text_of

#: Bits for a word's position beside its window's hash; longer documents compare all windows as text.
POSITION_BITS = 21
#: Phrases that mark a line as boilerplate, as one pattern over the lower-case line.
BOILERPLATE = (
    r"(?:^|[^a-z])(?:all rights reserved|licen[sc]ed under|is licensed|released under the|copyright \(c\)|cookie policy|use cookies|"
    r"privacy policy|terms of (?:use|service)|enable javascript|javascript is disabled|lorem ipsum|sign up for our|"
    r"subscribe to our|click here to|"
    r"tous droits réservés|politique de confidentialité|utilise des cookies|mentions légales|conditions d.utilisation|abonnez-vous à|"
    r"alle rechte vorbehalten|datenschutzerklärung|verwendet cookies|nutzungsbedingungen|abonnieren sie|"
    r"todos los derechos reservados|política de privacidad|utiliza cookies|términos de uso|suscríbete a)"
)
#: A line of the lower-case text that is a menu's entry.
NAVIGATION = (
    r"^[\x20\x09-\x0D]*(?:home|menu|search|log ?in|log ?out|sign in|sign up|contact(?: us)?|about(?: us)?|site ?map|skip to content|back to top|"
    r"next page|previous page|read more|share this|accueil|connexion|rechercher|plan du site|lire la suite|startseite|anmelden|suche|impressum|"
    r"weiterlesen|inicio|iniciar sesión|buscar|contacto|mapa del sitio|leer más)[\x20\x09-\x0D.!:>»]*$"
)
#: Characters of a line from which on it is a paragraph, if a sentence ends in it.
LONG_LINE = 200
#: Marks that close a line, and those that end a sentence: the latter with a space behind or a wide form by itself.
LATIN_CLOSE = """.!?…:;"'’”»)"""
OTHER_CLOSE = "。．！？｡；：」』）》】〉।॥؟؛۔։።፧၊။។៕"
SENTENCE_END = r"""[.!?…]["'’”»)\]]*([\x20\x09-\x0D]|$)|[。．！？｡।॥؟۔։።፧။។៕]"""
WORD_GAP = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds _repeat, the number of words inside a three-word window that the text holds twice or more."""
    mask = (1 << POSITION_BITS) - 1
    df = df.withColumn(
        "_packed",
        F.expr(
            f"""case when size(_words) < 4 or size(_words) > {mask} then array()
            else sort_array(transform(sequence(0, size(_words) - 3),
                 i -> shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), {POSITION_BITS}) | cast(i as bigint))) end"""
        ),
    )
    df = df.withColumn(
        "_maybe",
        F.expr(
            f"""case when size(_words) > {mask} then sequence(0, size(_words) - 3)
            else transform(filter(_packed, (x, i) ->
                   coalesce(shiftright(x, {POSITION_BITS}) = shiftright(get(_packed, i + 1), {POSITION_BITS}), false)
                or coalesce(shiftright(x, {POSITION_BITS}) = shiftright(get(_packed, i - 1), {POSITION_BITS}), false)),
                x -> cast(x & {mask} as int)) end"""
        ),
    ).drop("_packed")
    df = df.withColumn(
        "_wins",
        F.expr("sort_array(transform(_maybe, p -> struct(concat_ws(' ', _words[p], _words[p + 1], _words[p + 2]) as w, p as p)))"),
    ).drop("_maybe")
    df = df.withColumn(
        "_starts",
        F.expr(
            """sort_array(transform(filter(_wins, (x, i) -> coalesce(x.w = get(_wins, i + 1).w, false)
               or coalesce(x.w = get(_wins, i - 1).w, false)), x -> x.p))"""
        ),
    ).drop("_wins")
    covered = F.expr(
        "aggregate(transform(_starts, (p, i) -> least(3, coalesce(get(_starts, i + 1) - p, 3))), 0, (a, b) -> a + b)"
    )
    return df.withColumn("_repeat", covered.cast("long")).drop("_starts")


def judge(
    docs: DataFrame,
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_lost: float = 0.5,
    long_lines: bool = True,
) -> DataFrame:
    """All rows of ``docs`` with the counts, ``base_failed``, ``lost_chars``, ``kept`` and ``clean_text``."""
    box = Boxed(docs)
    own = box.df.columns
    df = box.df.withColumn("_text", text_of(box.col(text_col)))
    df = df.withColumn("_bare", F.btrim("_text", F.lit(ASCII_SPACE)))
    df = df.withColumn("_words", F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", WORD_GAP)))
    df = df.withColumn("_lines", F.split("_text", "\n", -1))
    closed = rf"[{LATIN_CLOSE}{OTHER_CLOSE if long_lines else ''}\]][\x20\x09-\x0D]*$"

    def good(line: Column) -> Column:
        well_formed = line.rlike(closed) & ~F.lower(line).rlike(BOILERPLATE)
        if long_lines:
            well_formed = well_formed | ((F.length(line) >= LONG_LINE) & line.rlike(SENTENCE_END))
        return ~line.rlike(r"[^\x20\x09-\x0D]") | (
            (F.regexp_count(line, F.lit(r"[#*$%&|<>]")) * 50 <= F.length(line))
            & (F.regexp_count(line, F.lit("!!")) < 2)
            & (F.regexp_count(line, F.lit("[|»›•·]")) < 3)
            & ~F.lower(line).rlike(NAVIGATION)
            & well_formed
        )

    df = df.withColumn("_good", F.filter("_lines", good))
    df = df.withColumn("_used", F.expr(r"filter(_lines, l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.select(
        *own,
        "_words",
        F.size("_words").cast("long").alias("_n"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("_symbols"),
        (F.size("_used") - F.size(F.array_distinct("_used"))).cast("long").alias("_dups"),
        F.array_join("_good", "\n").alias("_clean"),
        F.char_length("_text").alias("_len"),
    )
    df = _repeated_words(df).drop("_words")
    # predicates do not pass an observation: a filter on the verdict reads the counts made here in place of having Spark
    # substitute the whole chain of steps, each of which refers to the last several times, into itself
    df = df.observe(f"quality-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("judged"))
    # line breaks that went with removed lines do not count as lost text
    lost = F.greatest(F.lit(0), F.col("_len") - F.char_length("_clean")).cast("long")
    df = df.withColumn("_lost", lost)
    failed = (F.col("_n") < min_words) | (100 * F.col("_repeat") > max_repeat_percent * F.col("_n"))
    df = df.withColumn("_failed", failed)
    kept = ~F.col("_failed") & (F.col("_lost") <= max_lost * F.col("_len"))
    values = {
        "n_words": F.col("_n"),
        "word_chars": F.col("_chars"),
        "n_symbols": F.col("_symbols"),
        "n_dup_lines": F.col("_dups"),
        "n_repeat_words": F.col("_repeat"),
        "base_failed": F.col("_failed"),
        "lost_chars": F.col("_lost"),
        "kept": kept,
        "clean_text": F.col("_clean"),
    }
    return box.restore(df, values)
