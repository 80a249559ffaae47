"""Words."""

from reviewloom.operators import heavy, words

from .inputs import TOKENS, ctes
from .registry import query

_WORDS = dict(words=f"select unnest(regexp_extract_all(lower(comment), '{TOKENS}')) as word from clean")


@query(
    "word_frequency",
    ctes("clean", **_WORDS)
    + "select word, count(*) as count from words group by word order by count desc, word limit 10",
)
def word_frequency(t):
    return words.word_frequency(t.clean())


@query(
    "word_frequency_first_seen",
    ctes(
        "clean",
        lists=f"select review_id, regexp_extract_all(lower(comment), '{TOKENS}') as list from clean",
        words="select review_id, unnest(list) as word, generate_subscripts(list, 1) as pos from lists",
        counted="""select word, count(*) as count, min(review_id) as first_review from words group by word""",
        placed="""select c.word, c.count, c.first_review, min(w.pos) as first_pos from counted c
 join words w on w.word = c.word and w.review_id = c.first_review group by all""",
    )
    + """select word, count from placed order by count desc, first_review, first_pos limit 200""",
)
def word_frequency_first_seen(t):
    return words.word_frequency(t.clean(), k=200, first_seen=["review_id"])


@query(
    "vocabulary_size",
    ctes("clean", **_WORDS) + "select count(distinct word) as total_unique_words from words",
)
def vocabulary_size(t):
    return words.vocabulary_size(t.clean())


@query(
    "letter_words",
    ctes(
        "clean",
        runs=r"select unnest(regexp_extract_all(lower(comment), '[\p{L}\p{N}_]+')) as word from clean",
    )
    + """select word, count(*) as count from runs where regexp_full_match(word, '[a-zá-ú]+')
 group by word order by count desc, word limit 20""",
)
def letter_words(t):
    return words.letter_words(t.clean())


@query(
    "digit_runs",
    ctes("clean", lists=r"select review_id, regexp_extract_all(comment, '\p{Nd}+') as list from clean")
    + """select review_id, cast(generate_subscripts(list, 1) - 1 as int) as position,
 unnest(list) as digits from lists""",
)
def digit_runs(t):
    return words.digit_runs(t.clean(), "comment", "review_id")


@query(
    "frequent_words",
    ctes("clean", **_WORDS)
    + "select word, count(*) as count from words group by word order by count desc, word limit 20",
)
def frequent_words(t):
    return heavy.frequent_words(t.clean(), k=20)
