"""Text features against a plain-Python statement of the same definitions."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seamstat.functions import lexicons as lex
from seamstat.operators.text_features import nlp_features, text_features, visual_text_features
from seamstat.schema import NLP_FEATURES, VISUAL_FEATURES

EDGES = [
    "", "   ", "Don't LOVE it!!! 'love' ill-fitting true-to-size", "İstanbul K ß Ⓐ Ⅷ É",
    "² ① ٣ 5 ፩ ⓪", "☀ ☁ ➾ ➿ ❤ 😀", "isn’t isn't", "a.b!c?d...", "x\x1c. y", "\x1c\x1f. .",
    "would recommend, would recommend! tell friends", "#fav ##x", "'", "runs small runs large",
    "not as pictured as pictured", "red Red blue", " .　!", "no\u0085way .   .",
]


def expected(text):
    low = text.lower()
    tokens = re.findall(r"[a-zA-Z']+", low)
    count = lambda words: sum(t in set(words) for t in tokens)
    present = lambda words: sum(w in tokens for w in words)
    phrases = lambda ps: sum(p in low for p in ps)
    sentences = max(sum(1 for s in re.split(r"[.!?]+", text) if s.strip()), 1)
    unique = len(set(tokens)) / max(len(tokens), 1)
    row = {name: count(words) for name, words in lex.COUNTED.items()}
    row |= {name: present(words) for name, words in lex.PRESENT.items()}
    return row | {
        "nlp_char_count": len(text),
        "nlp_word_count": len(tokens),
        "nlp_sentence_count": sentences,
        "nlp_avg_word_len": sum(map(len, tokens)) / len(tokens) if tokens else 0.0,
        "nlp_unique_word_ratio": unique,
        "nlp_exclamation_count": text.count("!"),
        "nlp_question_count": text.count("?"),
        "nlp_uppercase_ratio": sum(c.isupper() for c in text) / max(len(text), 1),
        "nlp_digit_count": sum(c.isdigit() for c in text),
        "nlp_sentiment_net": count(lex.POSITIVE) - count(lex.NEGATIVE),
        "nlp_recommend_signal": phrases(lex.RECOMMEND_PHRASES),
        "nlp_avg_sentence_len": len(tokens) / sentences,
        "nlp_repetition_ratio": 1.0 - unique,
        "nlp_emoji_count": sum(0x2600 < ord(c) < 0x27BF for c in text),
        "nlp_hashtag_count": text.count("#"),
        "vis_photo_accuracy_signal": phrases(lex.PHOTO_MATCH_PHRASES) - phrases(lex.PHOTO_MISMATCH_PHRASES),
        "vis_multicolor_signal": int(count(lex.COLOR) >= 2),
    }


def check(spark, pairs):
    rows = [(i, title, review) for i, (title, review) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "id int, Title string, `Review Text` string")
    got = {row["id"]: row for row in text_features(frame).collect()}
    for i, title, review in rows:
        text = (title or "") + " " + (review or "")
        want = expected(text)
        for name in NLP_FEATURES + VISUAL_FEATURES:
            assert got[i][name] == want[name], (name, text)


def test_edge_strings(spark):
    check(spark, [(None, e) for e in EDGES] + [(e, None) for e in EDGES] + [(None, None)])


def test_every_listed_word_and_phrase(spark):
    words = sorted({w for ws in [*lex.COUNTED.values(), *lex.PRESENT.values()] for w in ws})
    phrases = lex.RECOMMEND_PHRASES + lex.PHOTO_MATCH_PHRASES + lex.PHOTO_MISMATCH_PHRASES
    check(spark, [(w.upper(), f"{w}, {w} x{w}") for w in words] + [(p, f"..{p}..") for p in phrases])


# Characters that any Java and Python version classify alike.
ALPHABET = st.sampled_from("aAbBzZ'’.!?#5 ²①٣ÉéßⒶⅧ☁❤😀İKΣ\n\t\x1c  -") | st.sampled_from(
    [" love ", " return ", " as pictured ", " buy again ", " dark ", " red "]
)
TEXT = st.lists(ALPHABET, max_size=30).map("".join)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.none() | TEXT, TEXT), min_size=30, max_size=60))
def test_random_text(spark, pairs):
    check(spark, pairs)


def test_word_list_sizes():
    sizes = [len(set(words)) for words in lex.COUNTED.values()]
    assert sizes == [24, 26, 13, 24, 5, 20, 15, 15, 13, 7, 31, 16, 20, 20]


def test_single_blocks_equal_the_joint_block(spark, presets):
    both = text_features(presets).orderBy("review_id").collect()
    for block, names in ((nlp_features, NLP_FEATURES), (visual_text_features, VISUAL_FEATURES)):
        for a, b in zip(block(presets).orderBy("review_id").collect(), both):
            assert [a[n] for n in names] == [b[n] for n in names]


def test_features_do_not_shuffle_and_tokenise_once(spark, presets):
    plan = text_features(presets)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2  # words and sentences
    physical = text_features(presets)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in physical
