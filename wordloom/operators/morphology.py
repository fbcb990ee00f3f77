"""Stemming and lemmatization of text columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.arrays import bind, fill_gaps
from wordloom.functions.porter import stem_text
from wordloom.functions.text import join_words, valid_words
from wordloom.operators.inrow import replaced
from wordloom.operators.joins import is_small, lookup, with_row_id
from wordloom.operators.validate import check_columns
from wordloom.sources.scratch import materialise

# Noun endings and what a lemma has in their place.
NOUN_RULES = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]
# A word joins the lexicon a corpus gives when at least so many texts contain it.
MIN_TEXTS = 3
# Texts with so many different changed words or fewer look them up in a map; others are put in order.
FEW = 48


def stem(df: DataFrame, id: str, col: str, extended: bool = True) -> DataFrame:
    """Replace every text by the stems of its valid words, in order. Works inside the row."""
    check_columns(df, [id, col])
    return df.withColumn(col, stem_text(F.col(col), extended))


def _word_texts(df: DataFrame, col: str) -> DataFrame:
    """``(word, texts)``: every valid word and the number of texts with it."""
    word = F.explode(F.array_distinct(valid_words(F.col(col))))
    return df.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("texts"))


def corpus_lexicon(df: DataFrame, col: str, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``(lemma)``: the valid words that at least ``min_texts`` texts contain."""
    return _word_texts(df, col).where(F.col("texts") >= min_texts).select(F.col("word").alias("lemma"))


def lemma_table(lexicon: DataFrame, exceptions: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """``(word, lemma)`` for every word that changes, by the rules only for those of ``words`` ``(word)`` where they are given.

    Candidates of a word are itself and what the noun rules make of it, if the lexicon ``(lemma)`` holds them; the shortest wins,
    the alphabetically first among equals. The rules are read backwards, from a lemma to the words it can stand for, so the table
    depends on no text. ``exceptions`` is ``(word, lemma)`` and goes before the rules.
    """
    lemma = F.col("lemma")
    forms = [F.when(lemma.endswith(new), F.concat(F.left(lemma, F.length(lemma) - len(new)), F.lit(end))) for end, new in NOUN_RULES]
    formed = lexicon.select(lemma, F.explode(F.array_compact(F.array(lemma, *forms))).alias("word"))
    if words is not None:
        formed = formed.join(words, "word", "left_semi")
    found = formed.groupBy("word").agg(F.min(F.struct(F.length("lemma").alias("size"), lemma))["lemma"].alias("lemma"))
    if exceptions is not None:
        fixed = exceptions.where("word IS NOT NULL AND lemma IS NOT NULL").groupBy("word").agg(F.min("lemma").alias("fixed"))
        found = found.join(fixed, "word", "full").select("word", F.coalesce("fixed", "lemma").alias("lemma"))
    return found.where("lemma != word")


def _may_change(w: Column, with_exceptions: bool) -> Column:
    return F.lit(True) if with_exceptions else w.endswith("s") | w.endswith("men")


def _looked_up(words: Column, lemmas: Column, with_exceptions: bool) -> Column:
    """The words, each by its lemma, for a text with few of them: words that cannot change are not looked up."""

    def by_map(known: Column) -> Column:
        return F.transform(words, lambda w: F.when(_may_change(w, with_exceptions), F.coalesce(F.try_element_at(known, w), w)).otherwise(w))

    return bind(F.map_from_entries(F.transform(lemmas, lambda x: F.struct(x["word"], x["value"]))), by_map)


def _replaced(words: Column, lemmas: Column) -> Column:
    """The words, each by its lemma. ``lemmas`` has ``at`` and ``value``: places in the ordered list of distinct words, and lemmas.

    Words are ordered, so that equal ones make runs; a run takes the lemma of its place, and the old order is restored. No list is
    searched, so the time grows with the number of words alone, but for the sorting.
    """

    def by_run(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), size),
            lambda i: (i < size) & ((i == 0) | (F.get(ordered, i)["word"] != F.get(ordered, i - 1)["word"])),
        )

        def placed(s: Column) -> Column:
            def run(known: Column) -> Column:
                def members(start: Column, r: Column) -> Column:
                    own = F.slice(ordered, start + 1, F.coalesce(F.get(s, r + 1), size) - start)
                    return F.transform(own, lambda x: F.struct(x["place"].alias("place"), F.coalesce(F.get(known, r), x["word"]).alias("word")))

                return F.flatten(F.transform(s, members))

            return bind(fill_gaps(lemmas, F.size(s), F.lit(None).cast("string")), run)

        return F.transform(F.sort_array(bind(starts, placed)), lambda x: x["word"])

    numbered = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("place")))
    return bind(F.sort_array(numbered), by_run)


def lemmatize_numbered(
    rows: DataFrame, row: str, col: str, lexicon: DataFrame, exceptions: DataFrame | None = None, in_row: bool = False
) -> DataFrame:
    """``lemmatize`` for a written table whose column ``row`` tells its rows apart.

    With ``in_row``, the lemmas of the words that occur and change, if they may be broadcast, are put in place in Arrow, so that no
    text is shuffled.
    """
    words = valid_words(F.col(f"`{col}`"))
    changing = F.array_distinct(F.filter(words, lambda w: _may_change(w, exceptions is not None)))
    table = materialise(lemma_table(lexicon, exceptions, rows.select(F.explode(changing).alias("word")).distinct()), "lemmas")
    if in_row and is_small(table):
        return rows.withColumn(col, replaced(words, rows.sparkSession.sparkContext.broadcast(table.toArrow().combine_chunks())))
    distinct = F.posexplode(F.sort_array(F.array_distinct(words))).alias("at", "word")
    pairs = rows.select(row, distinct).where(_may_change(F.col("word"), exceptions is not None))
    found = lookup(pairs, table, "word", row).groupBy(row)
    found = found.agg(F.collect_list(F.struct("at", "word", F.col("lemma").alias("value"))).alias("_lemmas"))
    # The lists grow with the table: never a broadcast.
    joined = rows.join(found.hint("merge"), row, "left")
    lemmas = F.col("_lemmas")
    changed = F.when(lemmas.isNull(), words).when(F.size(lemmas) <= FEW, _looked_up(words, lemmas, exceptions is not None))
    changed = changed.otherwise(_replaced(words, F.sort_array(lemmas)))
    return joined.withColumn(col, join_words(changed)).select(*[F.col(f"`{c}`") for c in rows.columns])


def lemmatize(df: DataFrame, id: str, col: str, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Replace every text by the noun lemmas of its valid words, in order.

    ``lexicon`` ``(lemma)`` says which forms are words; ``corpus_lexicon`` makes one. It is an input, so a text gets the same
    lemmas whatever other texts stand beside it. The rows are written once with a number each; their distinct words that a rule
    can change meet the lemma table in a join and come back as one list per row. Ids may be null or repeated; null stays null.
    """
    check_columns(df, [id, col])
    row = "_row"
    while row in df.columns:
        row += "_"
    return lemmatize_numbered(with_row_id(df, row), row, col, lexicon, exceptions).drop(row)
