"""Line-first cleaning: rules on every line, then a verdict on what a document loses.

All of it is column expressions over the row's own text; nothing is shuffled.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dayloom.llm.common import SPACES, let, table, words

# Fixed values of the rules, written for Java and RE2 alike.
SYMBOLS = "#*$%&|<>"
A_WORD = r"[^\x20\x09-\x0D]"
ENDS_WELL = r"[.!?:;…\"'”’»)\]][\x20\x09-\x0D]*\z"
DOUBLED_MARKS = r"[.!?,]{2,}[\"'”’»)\]]*([\x20\x09-\x0D]|\z)"
MENU_LINE = (r"(?i)^[\x20\x09-\x0D]*(home|about us|contact|contact us|log ?in|log ?out|sign (in|up|out)|menu|search|"
             r"next|previous|next page|previous page|back to top|read more|share|share this|skip to (main )?content|"
             r"startseite|impressum|datenschutz|accueil|plan du site|inicio|aviso legal)[\x20\x09-\x0D.:>»]*\z")
BOILERPLATE = (r"(?i)(we use cookies|accept (all )?cookies|cookie policy|privacy policy|terms of (use|service)|"
               r"all rights reserved|enable javascript|lorem ipsum|click here to|subscribe to our|sign up for our|"
               r"powered by wordpress|copyright (\(c\)|©|[0-9]{4}))")
#: Each match of BOILERPLATE has one of these, in lower case.
BOILERPLATE_KEYS = ("cookie", "privacy policy", "terms of ", "all rights reserved", "enable javascript", "lorem ipsum",
                    "click here to", "subscribe to our", "sign up for our", "powered by wordpress", "copyright ")
SEPARATORS = "|»·•>"
#: A symbol or separator.
MARKED = r"[#*$%&|<>»·•]"
#: An unfinished line is kept from this many words on; it is then prose that was cut.
OPEN_WORDS = 20
#: Share of a document's word characters that may go.
MAX_LOSS = 0.5
MIN_WORDS = 50
LOW = 2**32 - 1
HIGH = -(2**32)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def word_chars(text: Column) -> Column:
    return _without(text, SPACES)


def may_have_boilerplate(text: Column) -> Column:
    """False only where no line can match BOILERPLATE: a cheap look at all of a text before its regular expression."""
    lower = F.lower(text)
    return reduce(lambda a, b: a | b, (lower.contains(k) for k in BOILERPLATE_KEYS))


def bad_line(line: Column, boilerplate: Column) -> Column:
    """True if a rule fails the line; lines without a word pass.

    Cheap tests stand before those they imply, so most lines meet few regular expressions.
    """
    n = F.size(words(line))
    separators = F.length(line) - _without(line, SEPARATORS)
    symbols = F.length(line) - _without(line, SYMBOLS)
    marked = line.rlike(MARKED)
    punctuation = (~(line.endswith(".") | line.rlike(ENDS_WELL)) & (n < OPEN_WORDS)) | (
        marked & (symbols * 10 > word_chars(line))) | (
        line.rlike(DOUBLED_MARKS) & (F.regexp_count(line, F.lit(DOUBLED_MARKS)) * 2 > n))
    navigation = (marked & (separators >= 2) & (separators * 3 >= n)) | line.rlike(MENU_LINE)
    return line.rlike(A_WORD) & (punctuation | navigation | (boilerplate & line.rlike(BOILERPLATE)))


def repeated_words(word: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array.

    Windows are compared by a 64-bit hash of their words.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(3)]))

    def covered(at):
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))),
                           F.lit(0), lambda a, b: a + b)

    def twice(pairs):
        same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
        return F.filter(pairs, lambda e, i: same(e, F.get(pairs, i - 1)) | same(e, F.get(pairs, i + 1)))

    def near(marks):  # a long sorts much faster than a pair, so whole hashes meet only where their high halves do
        same = lambda e, other: F.coalesce(e.bitwiseXOR(other).bitwiseAND(HIGH) == 0, F.lit(False))
        return F.filter(marks, lambda e, i: same(e, F.get(marks, i - 1)) | same(e, F.get(marks, i + 1)))

    def count(h):
        marks = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(HIGH).bitwiseOR(i.cast("long"))))
        pairs = lambda m: F.sort_array(F.transform(m, lambda e: let(e.bitwiseAND(LOW).cast("int"), lambda i: F.struct(
            F.get(h, i).alias("h"), i.alias("i")))))
        found = lambda m: let(F.sort_array(F.transform(let(pairs(m), twice), lambda e: e["i"])), covered)
        return let(let(marks, near), lambda m: F.when(F.size(m) > 0, found(m)).otherwise(0))

    return F.when(F.size(word) >= 4, let(windows, count)).otherwise(0).cast("long")


def line_quality(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """All columns of ``docs`` plus a struct ``quality`` with counts, verdicts and ``clean`` text.

    In: ``text`` and any further columns (one named ``quality`` is replaced).  Lines are split at
    \\n; a line that fails a rule goes, the others are joined by \\n in ``clean``.  ``kept`` is
    false for texts that fail the base rules or lose over ``max_loss`` of their word characters.
    A null or blank text has no words, fails the base rules and has a clean text without words.
    Repeated rows get equal verdicts.  An empty table gives an empty table.
    """
    names = [c for c in docs.columns if c != "quality"]
    return _judged(docs, max_loss).select(*[F.col("row")[c].alias(c) for c in names], "quality")


def _judged(docs: DataFrame, max_loss: float) -> DataFrame:
    """(row, quality): the input row as a struct, so no column name can clash."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"), words(F.col("text")).alias("word"),
                       F.split(text, "\n", -1).alias("line"))
    rows = rows.withColumn("good", let(may_have_boilerplate(F.col("text")), lambda b: F.filter("line", lambda x: ~bad_line(x, b))))
    with_word = F.filter("line", lambda x: x.rlike(A_WORD))
    rows = rows.select(
        "row", F.size("word").cast("long").alias("n_words"), word_chars(F.col("text")).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        let(with_word, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("word")).alias("n_repeat_words"), F.array_join("good", "\n").alias("clean"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    left = word_chars(F.col("clean"))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("word_chars") - left <= max_loss * F.col("word_chars")))
    verdict = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean")
    # one row each; a filter on the verdict stays above it instead of repeating all of the above
    return rows.select("row", F.explode(F.array(verdict)).alias("quality"))


def cleaned(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """Documents that pass, with their failed lines removed and ``n_chars`` counted anew."""
    rows = _judged(docs, max_loss).where("quality.kept")
    new = {"text": F.col("quality.clean"), "n_chars": F.length("quality.clean").cast("long")}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


OUT = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality(docs).select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in OUT])


def _sql(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def _count(text, pattern):
    return f"len(regexp_extract_all({text}, {_sql(pattern)}))"


def _less(text, chars):
    return reduce(lambda t, c: f"replace({t}, chr({ord(c)}), '')", chars, text)


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS word,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_sql(A_WORD)})) AS line FROM d),
u AS (SELECT r, unnest(word) AS w, unnest(range(len(word))) AS i FROM w),
g AS (SELECT r, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
p AS (SELECT r, count(DISTINCT pos)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM t WHERE n > 1) GROUP BY r),
x AS (SELECT r, x, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n, length({_less('x', SPACES)}) AS chars,
  length(x) - length({_less('x', SEPARATORS)}) AS seps, length(x) - length({_less('x', SYMBOLS)}) AS symbols
  FROM (SELECT r, unnest(line) AS x FROM w)),
b AS (SELECT r, sum(chars) AS lost FROM x WHERE
  (NOT regexp_matches(x, {_sql(ENDS_WELL)}) AND n < {OPEN_WORDS}) OR symbols * 10 > chars
  OR {_count('x', DOUBLED_MARKS)} * 2 > n OR (seps >= 2 AND seps * 3 >= n)
  OR regexp_matches(x, {_sql(MENU_LINE)}) OR regexp_matches(x, {_sql(BOILERPLATE)}) GROUP BY r),
c AS (SELECT w.r, doc_id, len(word)::BIGINT AS n_words, length({_less('text', SPACES)})::BIGINT AS word_chars,
  (length(text) - length({_less('text', SYMBOLS)}))::BIGINT AS n_symbols,
  (len(line) - len(list_distinct(line)))::BIGINT AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
  coalesce(lost, 0) AS lost FROM w LEFT JOIN p USING (r) LEFT JOIN b USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= {MAX_LOSS} * word_chars AS kept FROM c
"""
