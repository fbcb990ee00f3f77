"""The registered queries as SQL text for another engine, on the same tables."""

import logging
from collections.abc import Callable

from wordloom.constants import (
    CLEANING_ERROR,
    DETECTION_ERROR,
    DETECTION_FAILED,
    ENTER_TEXT,
    LABEL_MAPS,
    LANGUAGE_NOT_SUPPORTED,
    NO_PREDICTION,
    PREDICTION_ERROR,
    PUNCTUATION,
    SPECIAL_CHARS,
    UNKNOWN_CLASS,
    UNSUPPORTED_LANGUAGE,
)
from wordloom.functions import porter
from wordloom.functions.stopwords import stopword_lists
from wordloom.operators.morphology import MIN_TEXTS, NOUN_RULES
from wordloom.options import PRESET, CleanOptions

log = logging.getLogger(__name__)


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def _valid_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: regexp_full_match(w, '\\p{{L}}{{2,}}'))"


def _punctuation(text: str) -> str:
    return f"translate({text}, {quoted(PUNCTUATION)}, '')"


def _special(text: str) -> str:
    return f"translate({text}, {quoted(SPECIAL_CHARS)}, '')"


def _upper(text: str) -> str:
    return f"upper(replace({text}, 'ß', 'SS'))"


def _stopwords(text: str, lang: str) -> str:
    """``lang`` is a quoted code or the name of a column of codes."""
    lists = stopword_lists()
    if lang.startswith("'"):
        hit = f"lower(w) IN {_in(lists[lang.strip(chr(39))])}"
    else:
        cases = " ".join(f"WHEN {quoted(code)} THEN lower(w) IN {_in(found)}" for code, found in lists.items())
        hit = f"CASE {lang} {cases} ELSE false END"
    return f"array_to_string(list_filter({_words(text)}, lambda w: NOT coalesce({hit}, false)), ' ')"


def _clean(text: str, options: CleanOptions, lang: str) -> str:
    if options.remove_punctuation:
        text = _punctuation(text)
    if options.remove_special_chars:
        text = _special(text)
    if options.convert_to_lowercase:
        text = f"lower({text})"
    if options.convert_to_uppercase:
        text = _upper(text)
    if options.remove_stopwords:
        text = _stopwords(text, lang)
    return text


# Each builder below returns common table expressions; names are prefixed with ``p`` to keep them apart.


def _lexicon(p: str, rows: str) -> str:
    return f"""
    {p}_lex AS (
      SELECT lemma FROM (SELECT unnest(list_distinct({_valid_words('text')})) AS lemma FROM {rows})
      GROUP BY lemma HAVING count(*) >= {MIN_TEXTS})"""


def _lemmas(p: str, rows: str, lexicon: str) -> str:
    """``{p}_out(doc_id, text)``: the lemmas of the texts in ``rows(doc_id, text)``."""
    rules = " UNION ALL ".join(
        f"SELECT w, left(w, length(w) - {len(end)}) || {quoted(new)} AS lemma FROM {p}_changeable WHERE ends_with(w, {quoted(end)})"
        for end, new in NOUN_RULES
    )
    return f"""
    {p}_words AS (SELECT doc_id, {_valid_words('text')} AS ws FROM {rows}),
    {p}_tokens AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM {p}_words),
    {p}_changeable AS (SELECT DISTINCT w FROM {p}_tokens WHERE ends_with(w, 's') OR ends_with(w, 'men')),
    {p}_candidates AS (SELECT w, w AS lemma FROM {p}_changeable UNION ALL {rules}),
    {p}_lemmas AS (
      SELECT w, first(lemma ORDER BY length(lemma), lemma) AS lemma
      FROM {p}_candidates SEMI JOIN {lexicon} USING (lemma) GROUP BY w),
    {p}_joined AS (
      SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY pos) AS text
      FROM {p}_tokens LEFT JOIN {p}_lemmas USING (w) GROUP BY doc_id),
    {p}_out AS (
      SELECT r.doc_id, coalesce(j.text, '') AS text FROM {rows} r LEFT JOIN {p}_joined j USING (doc_id))"""


def _profile() -> str:
    return """
    pf_words AS (
      SELECT lang, w, count(*) AS n
      FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM documents)
      WHERE w <> '' GROUP BY lang, w),
    pf_grams AS (
      SELECT lang, gram, sum(n)::BIGINT AS n
      FROM (SELECT lang, n, unnest(list_transform(range(1, length(w) + 1), lambda i: substr('_' || w || '_', i, 3))) AS gram
            FROM pf_words)
      GROUP BY lang, gram),
    profile AS (
      SELECT lang, gram, n, rank FROM
        (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank FROM pf_grams)
      WHERE rank <= 300)"""


def _detected() -> str:
    return (
        _profile()
        + """,
    dt_words AS (
      SELECT doc_id, w, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM documents)
      WHERE w <> '' GROUP BY doc_id, w),
    dt_grams AS (
      SELECT doc_id, gram, sum(n) AS n
      FROM (SELECT doc_id, n, unnest(list_transform(range(1, length(w) + 1), lambda i: substr('_' || w || '_', i, 3))) AS gram
            FROM dt_words)
      GROUP BY doc_id, gram),
    dt_ranked AS (
      SELECT * FROM
        (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS r FROM dt_grams)
      WHERE r <= 300),
    dt_scores AS (
      SELECT doc_id, lang, sum(300 - abs(r - rank)) AS score FROM dt_ranked JOIN profile USING (gram)
      GROUP BY doc_id, lang),
    detected AS (
      SELECT d.doc_id, s.lang FROM documents d LEFT JOIN
        (SELECT doc_id, first(lang ORDER BY score DESC, lang) AS lang FROM dt_scores GROUP BY doc_id) s
      USING (doc_id))"""
    )


def _split(p: str, rows: str) -> str:
    """``{p}_split``: the columns of ``rows`` with ``is_test``."""
    return f"""
    {p}_split AS (
      SELECT * EXCLUDE (place, wanted), place <= wanted AS is_test FROM
        (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place,
                ceil(0.2::DOUBLE * count(*) OVER ()) AS wanted FROM {rows}))"""


def _terms(p: str, rows: str) -> str:
    return f"""
    {p}_terms AS (
      SELECT doc_id, term, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {rows})
      GROUP BY doc_id, term)"""


def _tfidf(p: str, terms: str, rows: str) -> str:
    return f"""
    {p}_texts AS (SELECT term, count(*) AS df FROM {terms} GROUP BY term),
    {p}_idf AS (
      SELECT term, ln((1 + (SELECT count(*) FROM {rows})) / (1 + df)) + 1 AS idf FROM {p}_texts),
    {p}_raw AS (SELECT doc_id, term, n * idf AS w FROM {terms} JOIN {p}_idf USING (term)),
    {p}_weights AS (
      SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS n FROM {p}_raw)"""


def _nb(p: str, train: str, train_terms: str, vocabulary: str, score: str, score_terms: str) -> str:
    """``{p}_pred(doc_id, prediction)`` for the rows of ``score``; ``train`` is ``(doc_id, label)``."""
    return f"""
    {p}_voc AS (SELECT DISTINCT term FROM {vocabulary}),
    {p}_counts AS (
      SELECT label, term, sum(n) AS c FROM {train_terms} JOIN {train} USING (doc_id) GROUP BY label, term),
    {p}_totals AS (SELECT label, sum(c) AS total FROM {p}_counts GROUP BY label),
    {p}_classes AS (
      SELECT label, ln(n / (SELECT count(*) FROM {train})) AS lp,
             ln(coalesce(total, 0) + (SELECT count(*) FROM {p}_voc)) AS lt
      FROM (SELECT label, count(*) AS n FROM {train} GROUP BY label) LEFT JOIN {p}_totals USING (label)),
    {p}_known AS (SELECT t.* FROM {score_terms} t SEMI JOIN {p}_voc USING (term)),
    {p}_length AS (SELECT doc_id, sum(n) AS l FROM {p}_known GROUP BY doc_id),
    {p}_own AS (
      SELECT doc_id, label, sum(n * ln(c + 1)) AS s FROM {p}_known JOIN {p}_counts USING (term)
      GROUP BY doc_id, label),
    {p}_pred AS (
      SELECT doc_id, first(label ORDER BY score DESC, label) AS prediction FROM
        (SELECT d.doc_id, c.label, round(lp - coalesce(l, 0) * lt + coalesce(s, 0), 6) AS score
         FROM {score} d CROSS JOIN {p}_classes c
         LEFT JOIN {p}_length USING (doc_id)
         LEFT JOIN {p}_own o ON o.doc_id = d.doc_id AND o.label = c.label)
      GROUP BY doc_id)"""


def _report(pairs: str) -> str:
    """The report over ``pairs(y, p)``."""
    return f"""
    rp_labels AS (SELECT y AS label FROM {pairs} UNION SELECT p FROM {pairs}),
    rp_counts AS (
      SELECT label, (SELECT count(*) FROM {pairs} WHERE y = label) AS support,
             (SELECT count(*) FROM {pairs} WHERE p = label) AS predicted,
             (SELECT count(*) FROM {pairs} WHERE p = label AND y = label) AS hits
      FROM rp_labels),
    rp AS (
      SELECT label, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
             2 * hits / (support + predicted) AS f1, support, hits FROM rp_counts),
    rp_rows AS (
      SELECT label, precision, recall, f1, support FROM rp
      UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits) / sum(support), sum(support) FROM rp
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rp
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                       sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rp)"""


_REPORT_SELECT = """SELECT label, round(precision::DOUBLE, 6) AS precision, round(recall::DOUBLE, 6) AS recall,
    round(f1::DOUBLE, 6) AS f1, support::BIGINT AS support FROM rp_rows"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _porter(table: str) -> str:
    """``stems(w, stem)`` for the distinct lowercase words of ``table(w)``: the extended form, which is the default."""

    def cut(n: int) -> str:
        return f"left(w, greatest(length(w) - {n}, 0))"

    def has(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {quoted(pattern)})"

    def suffixes(rules, measure: str, extra=lambda end, stem: "true") -> str:
        cases = " ".join(
            f"WHEN ends_with(w, {quoted(end)}) THEN CASE WHEN {has(cut(len(end)), measure)} AND {extra(end, cut(len(end)))}"
            f" THEN {cut(len(end))} || {quoted(new)} ELSE w END"
            for end, new in porter.longest_first(rules)
        )
        return f"CASE {cases} ELSE w END"

    cvc = porter.ENDS_CVC_OR_IS_VC
    tidy = f"""CASE WHEN NOT cutoff THEN w
      WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e'
      WHEN {has('w', '[^aeiouylsz]$')} AND right(w, 2) = right(w, 1) || right(w, 1) THEN {cut(1)}
      WHEN {has('w', porter.M_IS_1)} AND {has('w', cvc)} THEN w || 'e' ELSE w END"""
    ed = f"ends_with(w, 'ed') AND NOT ends_with(w, 'eed') AND NOT ends_with(w, 'ied') AND {has(cut(2), porter.HAS_VOWEL)}"
    ing = f"ends_with(w, 'ing') AND {has(cut(3), porter.HAS_VOWEL)}"
    stem_1 = cut(1)
    shortened = f"CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END"
    steps = [
        f"CASE WHEN ends_with(w, 'ies') THEN {shortened} WHEN ends_with(w, 'sses') THEN {cut(2)} "
        f"WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END",
        None,
        f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND {has(stem_1, porter.ENDS_CONSONANT)} THEN {stem_1} || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {has(cut(4), porter.M_OVER_0)} THEN {cut(2)} ELSE w END",
        f"CASE WHEN ends_with(w, 'logi') THEN CASE WHEN {has(cut(3), porter.M_OVER_0)} THEN {cut(1)} ELSE w END "
        f"ELSE {suffixes(porter.EXTENDED_STEP_2, porter.M_OVER_0)} END",
        suffixes(porter.STEP_3, porter.M_OVER_0),
        suffixes(
            [(end, "") for end in porter.STEP_4],
            porter.M_OVER_1,
            lambda end, stem: has(stem, "[st]$") if end == "ion" else "true",
        ),
        f"CASE WHEN ends_with(w, 'e') AND ({has(stem_1, porter.M_OVER_1)} OR ({has(stem_1, porter.M_IS_1)} "
        f"AND NOT {has(stem_1, cvc)})) THEN {stem_1} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {has(stem_1, porter.M_OVER_1)} THEN {stem_1} ELSE w END",
    ]
    parts = [f"\n    ps_0 AS (SELECT DISTINCT w AS word, w FROM {table})"]
    for i, step in enumerate(steps, 1):
        source = f"ps_{i - 1}"
        if step is None:
            parts.append(
                f"""
    ps_cut AS (SELECT word, {ed} OR {ing} AS cutoff,
      CASE WHEN ends_with(w, 'ied') THEN {shortened}
           WHEN ends_with(w, 'eed') THEN CASE WHEN {has(cut(3), porter.M_OVER_0)} THEN {cut(1)} ELSE w END
           WHEN {ed} THEN {cut(2)} WHEN {ing} THEN {cut(3)} ELSE w END AS w FROM {source})"""
            )
            step, source = tidy, "ps_cut"
        parts.append(f"\n    ps_{i} AS (SELECT word, {step} AS w FROM {source})")
    irregular = " ".join(f"WHEN word IN {_in(forms)} THEN {quoted(base)}" for base, forms in porter.IRREGULAR.items())
    parts.append(
        f"\n    stems AS (SELECT word AS w, CASE WHEN length(word) <= 2 THEN word {irregular} ELSE w END AS stem FROM ps_{len(steps)})"
    )
    return ",".join(parts)


_CATEGORY = "(substr(source, 4)::INTEGER % 7 + 1)::INTEGER"
_RAW = "SELECT doc_id, text FROM documents"


def _preset_rows(p: str, lang: str = "'en'", rows: str = "documents") -> str:
    return f"\n    {p} AS (SELECT doc_id, {_clean('text', PRESET, lang)} AS text FROM {rows})"


def _training(p: str, label: str) -> str:
    """Preset-cleaned documents with a corpus lexicon, split, with label: ``{p}_rows``."""
    return ",".join(
        [
            _preset_rows(f"{p}_pre"),
            _lexicon(p, f"{p}_pre"),
            _lemmas(p, f"{p}_pre", f"{p}_lex"),
            _split(p, "documents"),
            f"\n    {p}_train AS (SELECT doc_id, {label} AS label FROM {p}_split WHERE NOT is_test)",
            f"\n    {p}_test AS (SELECT doc_id, {label} AS label FROM {p}_split WHERE is_test)",
            _terms(p, f"{p}_out"),
        ]
    )


def _raw_lexicon() -> str:
    plain = f"lower({_special(_punctuation('text'))})"
    return f"\n    plain AS (SELECT {plain} AS text FROM documents)," + _lexicon("raw", "plain")


def _language_model(p: str, lang: str) -> str:
    """``{p}_pred``: the category model of one language, applied to the documents detected as that language."""
    return ",".join(
        [
            f"\n    {p}_docs AS (SELECT * FROM documents WHERE lang = {quoted(lang)})",
            _preset_rows(f"{p}_pre", quoted(lang), f"{p}_docs"),
            _lemmas(p, f"{p}_pre", "raw_lex"),
            _split(p, f"{p}_docs"),
            f"\n    {p}_train AS (SELECT doc_id, {_CATEGORY} AS label FROM {p}_split WHERE NOT is_test)",
            _terms(p, f"{p}_out"),
            f"""
    {p}_own_docs AS (SELECT doc_id, text FROM documents JOIN (SELECT doc_id FROM detected WHERE lang = {quoted(lang)})
      USING (doc_id))""",
            _preset_rows(f"{p}_own_pre", quoted(lang), f"{p}_own_docs"),
            _lemmas(f"{p}_own", f"{p}_own_pre", "raw_lex"),
            _terms(f"{p}_own", f"{p}_own_out"),
            _nb(p, f"{p}_train", f"{p}_terms", f"{p}_terms", f"{p}_own_docs", f"{p}_own_terms"),
        ]
    )


def _english_name(prediction: str) -> str:
    cases = " ".join(f"WHEN {id} THEN {quoted(name)}" for id, name in LABEL_MAPS["en"].items())
    return f"CASE {prediction} {cases} ELSE {quoted(UNKNOWN_CLASS)} END"


def _routed() -> str:
    return _with(
        _detected(),
        _raw_lexicon(),
        _language_model("en", "en"),
        _language_model("fr", "fr"),
        f"""
    routed AS (
      SELECT doc_id, {_english_name('prediction')} AS predicted_class FROM en_pred
      UNION ALL SELECT doc_id, prediction::VARCHAR FROM fr_pred)""",
    )


def builders() -> dict[str, Callable[[], str]]:
    """What makes the SQL text of each query."""
    out: dict[str, Callable[[], str]] = {}
    out["csv_source"] = lambda: "SELECT doc_id, text, lang, source, n_chars FROM documents"
    out["load_training_data"] = lambda: (
        f"SELECT doc_id AS id, text, {_CATEGORY} AS category FROM documents WHERE lang = 'en'"
    )
    out["csv_sink"] = lambda: f"SELECT doc_id, lower({_punctuation('text')}) AS text FROM documents"

    out["select_columns"] = lambda: "SELECT doc_id, lang, source FROM documents"
    in_place = CleanOptions(
        remove_punctuation=True, remove_special_chars=True, convert_to_lowercase=True, remove_stopwords=True
    )
    out["process_table"] = lambda: (
        _with(_detected())
        + f"""SELECT d.doc_id, CASE WHEN t.lang IS NULL THEN d.text ELSE {_clean('d.text', in_place, 't.lang')} END AS text,
    d.lang, d.source, d.n_chars FROM documents d JOIN detected t USING (doc_id)"""
    )
    status = f"""SELECT doc_id, digits, CASE WHEN trim(digits) = '' THEN {quoted(ENTER_TEXT)} ELSE 'ok' END AS status
    FROM (SELECT doc_id, regexp_replace(text, '[^0-9]+', ' ', 'g') AS digits FROM documents)"""
    out["validate_rows"] = lambda: status
    out["row_errors"] = lambda: f"""SELECT doc_id, result, result AS status
    FROM (SELECT doc_id, CASE WHEN trim(digits) <> '' THEN NULL WHEN lang = 'en' THEN {quoted(CLEANING_ERROR)}
        WHEN lang = 'fr' THEN {quoted(DETECTION_ERROR)} WHEN lang = 'de' THEN {quoted(PREDICTION_ERROR)}
        ELSE {quoted(NO_PREDICTION)} END AS result
      FROM (SELECT doc_id, lang, regexp_replace(text, '[^0-9]+', ' ', 'g') AS digits FROM documents))
    WHERE result IS NOT NULL"""
    out["null_cells"] = lambda: """SELECT doc_id, coalesce(quality::VARCHAR, 'nan') AS quality, coalesce(toxic::VARCHAR, 'nan') AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)"""

    out["remove_punctuation"] = lambda: f"SELECT doc_id, {_punctuation('text')} AS text FROM documents"
    out["remove_special_chars"] = lambda: f"SELECT doc_id, {_special('text')} AS text FROM documents"
    out["convert_to_lowercase"] = lambda: "SELECT doc_id, lower(text) AS text FROM documents"
    out["convert_to_uppercase"] = lambda: f"SELECT doc_id, {_upper('text')} AS text FROM documents"
    out["remove_stopwords"] = lambda: f"SELECT doc_id, {_stopwords('text', 'lang')} AS text FROM documents"
    out["valid_word_filter"] = lambda: f"SELECT doc_id, array_to_string({_valid_words('text')}, ' ') AS text FROM documents"
    out["stemming"] = lambda: (
        _with(
            f"""
    tokens AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
      FROM (SELECT doc_id, list_transform({_valid_words('text')}, lambda x: lower(x)) AS ws FROM documents))""",
            _porter("tokens"),
        )
        + """SELECT doc_id, coalesce(j.text, '') AS text FROM documents d LEFT JOIN
      (SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS text FROM tokens JOIN stems USING (w) GROUP BY doc_id) j
    USING (doc_id)"""
    ).replace("SELECT doc_id, coalesce(j.text, '')", "SELECT d.doc_id, coalesce(j.text, '')")
    out["lemmatization"] = lambda: (
        _with(_lexicon("lm", "documents"), _lemmas("lm", "documents", "lm_lex")) + "SELECT doc_id, text FROM lm_out"
    )
    out["clean_text"] = lambda: (
        _with(_preset_rows("pre"), _lexicon("ct", "pre"), _lemmas("ct", "pre", "ct_lex"))
        + "SELECT doc_id, text FROM ct_out"
    )

    out["detect_language"] = lambda: (
        _with(_detected())
        + f"""SELECT doc_id, lang, CASE WHEN lang IS NULL THEN {quoted(DETECTION_ERROR)} ELSE 'ok' END AS status
    FROM detected"""
    )
    out["language_profiles"] = lambda: _with(_profile()) + "SELECT lang, gram, n, rank FROM profile"
    out["language_gate"] = lambda: f"""SELECT doc_id, lang,
    CASE WHEN lang IN ('en', 'fr') THEN 'ok' ELSE {quoted(UNSUPPORTED_LANGUAGE)} END AS gate FROM documents"""

    out["class_distribution"] = lambda: (
        "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type"
    )
    out["remove_low_classes"] = lambda: """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
    SELECT event_id, event_type FROM events
    WHERE event_type IN (SELECT event_type FROM c WHERE n >= (SELECT avg(n) FROM c))"""
    out["balance_distribution"] = lambda: """SELECT doc_id, text, lang, source, n_chars FROM
      (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents)
    WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))"""
    out["train_test_split"] = lambda: _with(_split("s", "documents")) + "SELECT doc_id, lang, is_test FROM s_split"

    out["vectorize_count"] = lambda: _with(_terms("v", "documents")) + "SELECT doc_id, term, n AS weight FROM v_terms"
    out["vectorize_tfidf"] = lambda: (
        _with(_terms("v", "documents"), _tfidf("v", "v_terms", "documents"))
        + "SELECT doc_id, term, round(n, 6) AS weight FROM v_weights"
    )
    out["vectorize_hashing"] = lambda: (
        _with(
            _terms("v", "documents"),
            """
    hashed AS (SELECT doc_id, ('0x' || left(md5(term), 8))::BIGINT % 1048576 AS bucket, sum(n) AS n
      FROM v_terms GROUP BY ALL)""",
        )
        + "SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM hashed"
    )
    out["vectorizer_transform"] = lambda: (
        _with(
            _terms("v", "documents"),
            "\n    talks AS (SELECT conv_id || '-' || turn AS doc_id, text FROM conversations)",
            _terms("t", "talks"),
            """
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
      FROM v_terms GROUP BY term),
    raw AS (SELECT doc_id, term, n * idf AS w FROM t_terms JOIN idf USING (term))""",
        )
        + """SELECT doc_id AS turn_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
    FROM raw"""
    )

    scored = "SELECT doc_id, label, prediction FROM t_test JOIN m_pred USING (doc_id)"
    out["classify_naive_bayes"] = lambda: (
        _with(_training("t", "lang"), _nb("m", "t_train", "t_terms", "t_terms", "t_test", "t_terms")) + scored
    )
    out["model_store"] = out["classify_naive_bayes"]
    fitted = lambda: _with(_split("t", "documents")) + """SELECT count(*) FILTER (is_test) AS test_rows,
    0::BIGINT AS unknown_predictions, true AS accurate FROM t_split"""
    for name in ("svm", "random_forest", "logistic", "decision_tree", "gradient_boosting"):
        out[f"classify_{name}"] = fitted
    def nearest() -> str:
        return """
    sq AS (SELECT doc_id, coalesce(sum(n * n), 0) AS s FROM documents LEFT JOIN t_weights USING (doc_id) GROUP BY doc_id),
    dots AS (
      SELECT a.doc_id AS test_id, b.doc_id AS train_id, sum(a.n * b.n) AS dot
      FROM (SELECT w.* FROM t_weights w SEMI JOIN t_test USING (doc_id)) a
      JOIN (SELECT w.* FROM t_weights w SEMI JOIN t_train USING (doc_id)) b ON a.term = b.term
      GROUP BY a.doc_id, b.doc_id),
    near AS (
      SELECT te.doc_id AS test_id, te.label AS own, tr.label,
        row_number() OVER (PARTITION BY te.doc_id
          ORDER BY round(x.s + y.s - 2 * coalesce(dot, 0), 9), tr.doc_id) AS place
      FROM t_test te CROSS JOIN t_train tr
      JOIN sq x ON x.doc_id = te.doc_id JOIN sq y ON y.doc_id = tr.doc_id
      LEFT JOIN dots ON dots.test_id = te.doc_id AND dots.train_id = tr.doc_id),
    votes AS (SELECT test_id, own, label, count(*) AS v FROM near WHERE place <= 5 GROUP BY test_id, own, label),
    elected AS (SELECT test_id, own, first(label ORDER BY v DESC, label) AS prediction FROM votes GROUP BY test_id, own)"""

    out["model_selection"] = lambda: (
        _with(
            _training("t", "lang"),
            _tfidf("t", "t_terms", "t_out"),
            """
    buckets AS (SELECT unnest(range(1048576)) AS term),
    h_sums AS (SELECT doc_id, ('0x' || left(md5(term), 8))::BIGINT % 1048576 AS term, sum(n) AS n
      FROM t_terms GROUP BY ALL),
    h_terms AS (SELECT doc_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS n FROM h_sums)""",
            _nb("a", "t_train", "t_terms", "t_terms", "t_test", "t_terms"),
            _nb("b", "t_train", "t_weights", "t_terms", "t_test", "t_weights"),
            _nb("c", "t_train", "h_terms", "buckets", "t_test", "h_terms"),
            nearest(),
            """
    results AS (
      SELECT 0 AS place, 'Count' AS vectorizer, 'Naive Bayes' AS algorithm, avg((label = prediction)::INTEGER) AS accuracy
      FROM t_test JOIN a_pred USING (doc_id)
      UNION ALL SELECT 1, 'TF-IDF', 'Naive Bayes', avg((label = prediction)::INTEGER) FROM t_test JOIN b_pred USING (doc_id)
      UNION ALL SELECT 2, 'Hashing', 'Naive Bayes', avg((label = prediction)::INTEGER) FROM t_test JOIN c_pred USING (doc_id)
      UNION ALL SELECT 3, 'TF-IDF', 'KNN', avg((own = prediction)::INTEGER) FROM elected)""",
        )
        + """SELECT vectorizer, algorithm, round(accuracy, 6) AS accuracy,
      place = (SELECT place FROM results ORDER BY accuracy DESC, place LIMIT 1) AS best FROM results"""
    )
    out["classify_knn"] = lambda: (
        _with(_training("t", "lang"), _tfidf("t", "t_terms", "t_out"), nearest())
        + "SELECT test_id AS doc_id, own AS label, prediction FROM elected"
    )

    out["accuracy"] = lambda: "SELECT round(avg((quality = 1 - toxic)::INTEGER), 6) AS accuracy FROM labels"
    out["classification_report"] = lambda: (
        _with(
            """
    pairs AS (SELECT lang AS y, CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' le ') THEN 'fr'
      WHEN contains(text, ' und ') THEN 'de' ELSE 'es' END AS p FROM documents)""",
            _report("pairs"),
        )
        + _REPORT_SELECT
    )
    out["train_model"] = lambda: (
        _with(
            _training("t", "lang"),
            _tfidf("t", "t_terms", "t_out"),
            _nb("m", "t_train", "t_weights", "t_terms", "t_test", "t_weights"),
            "\n    pairs AS (SELECT label AS y, prediction AS p FROM t_test JOIN m_pred USING (doc_id))",
            _report("pairs"),
        )
        + _REPORT_SELECT
    )

    out["predict_class"] = lambda: (
        _with(
            _raw_lexicon(),
            _preset_rows("pre"),
            _lemmas("t", "pre", "raw_lex"),
            _split("t", "documents"),
            f"\n    t_train AS (SELECT doc_id, {_CATEGORY} AS label FROM t_split WHERE NOT is_test)",
            _terms("t", "t_out"),
            _nb("m", "t_train", "t_terms", "t_terms", "documents", "t_terms"),
        )
        + f"SELECT doc_id, {_english_name('prediction')} AS predicted_class FROM m_pred"
    )
    out["classify_table"] = lambda: (
        _routed()
        + f"""SELECT d.doc_id, d.source, CASE WHEN t.lang IN ('en', 'fr') THEN r.predicted_class
      ELSE {quoted(UNSUPPORTED_LANGUAGE)} END AS text_class
    FROM documents d JOIN detected t USING (doc_id) LEFT JOIN routed r USING (doc_id)"""
    )
    out["predict_table"] = lambda: (
        _with(
            _detected(),
            _raw_lexicon(),
            _preset_rows("pre"),
            _lemmas("t", "pre", "raw_lex"),
            _split("t", "documents"),
            "\n    t_train AS (SELECT doc_id, lang AS label FROM t_split WHERE NOT is_test)",
            _terms("t", "t_out"),
            "\n    told AS (SELECT doc_id, text, t.lang FROM documents d JOIN detected t USING (doc_id))",
            _preset_rows("told_pre", "lang", "told"),
            _lemmas("s", "told_pre", "raw_lex"),
            _terms("s", "s_out"),
            _nb("m", "t_train", "t_terms", "t_terms", "documents", "s_terms"),
        )
        + "SELECT doc_id, source, prediction AS text_class FROM documents JOIN m_pred USING (doc_id)"
    )
    options = CleanOptions(remove_punctuation=True, convert_to_uppercase=True, remove_stopwords=True)
    message = quoted(LANGUAGE_NOT_SUPPORTED).replace("%s", "' || t.lang || '")
    out["process_and_classify"] = lambda: (
        _routed()
        + f"""SELECT doc_id,
      CASE WHEN error IS NULL THEN processed END AS processed_text,
      CASE WHEN error IS NULL THEN predicted_class END AS classification_result,
      CASE WHEN error IS NULL THEN lang END AS language_detected, error
    FROM (SELECT d.doc_id, t.lang, r.predicted_class, {_clean('d.text', options, 't.lang')} AS processed,
        CASE WHEN trim(d.text) = '' THEN {quoted(ENTER_TEXT)} WHEN t.lang IS NULL THEN {quoted(DETECTION_FAILED)}
             WHEN t.lang NOT IN ('en', 'fr') THEN {message} END AS error
      FROM documents d JOIN detected t USING (doc_id) LEFT JOIN routed r USING (doc_id))"""
    )
    return out


def oracles() -> dict[str, str]:
    """The SQL texts. One that cannot be built is logged and left out; the others do not go with it."""
    out = {}
    for name, build in builders().items():
        try:
            out[name] = build()
        except Exception:
            log.exception("no SQL for %s", name)
    return out
