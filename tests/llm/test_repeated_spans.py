import random
import re

from seamstat.llm import repeated_spans as rs
from seamstat.llm.shingles import word_hashes
from tests.llm.brute import lowered

DOC = "doc_id bigint, text string, first int, last int, hash string"


def is_cut(word):
    """Whether the library cuts long sentences after this word."""
    return int(word_hashes(word.encode() + b" ")[1][0]) % rs.CUT == 0


def plain_sentences(text):
    """(first word, after the last) of each sentence, word by word."""
    found = list(re.finditer(r"[^ \t\n\x0b\x0c\r]+", text))
    ends = [
        i == len(found) - 1 or m[0].endswith((".", "!", "?", "…")) or "\n" in text[m.end() : found[i + 1].start()]
        for i, m in enumerate(found)
    ]
    out, start = [], 0
    for i, end in enumerate(ends):
        if end:
            cuts = [k + 1 for k in range(start, i) if i + 1 - start > rs.LONG and is_cut(lowered(found[k][0]))] + [i + 1]
            out += list(zip([start, *cuts], cuts))
            start = i + 1
    return found, out


def brute(rows):
    """Text kept of each row, by comparing the words of all spans."""
    places, parts = {}, []
    for doc, text in rows:
        found, sentences = plain_sentences(text or "")
        parts.append((found, sentences))
        if doc is None or text is None:
            continue
        words, made = [lowered(m[0]) for m in found], []
        for i in range(len(sentences)):
            for j in range(i + rs.SENTENCES - 1, len(sentences)):
                if sentences[j][1] - sentences[i][0] >= rs.WORDS:
                    made.append((sentences[i][0], sentences[j][1]))
                    break
        if made:
            made.append((made[-1][0], len(words)))
        for a, b in made:
            places.setdefault(tuple(words[a:b]), set()).add((doc, text, a, b))
    gone = {}
    for found in places.values():
        # Which text of one id is first is the order of a hash; the tests give such ids one text only.
        first = min((doc, a, b) for doc, _, a, b in found)
        for doc, text, a, b in found:
            if (doc, a, b) != first:
                gone.setdefault((doc, text), set()).update(range(a, b))
    out = []
    for (doc, text), (found, _) in zip(rows, parts, strict=True):
        starts = [0, *[m.start() for m in found[1:]], len(text or "")]
        kept = [text[starts[i] : starts[i + 1]] for i in range(len(found)) if i not in gone.get((doc, text), ())] if text else []
        out.append((doc, "".join(kept) if found else text))
    return out


def prose(draw, sentences):
    return " ".join(" ".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 12))).capitalize() + draw.choice([".", "!", "?\n", "..."]) for _ in range(sentences))


def test_equals_brute_force(spark):
    draw = random.Random(5)
    passage, run = prose(draw, 9), " ".join(f"word{i}" for i in range(90))
    rows = []
    for i in range(40):
        text = prose(draw, draw.randint(3, 12))
        if i % 3 == 0:
            text += " " + passage + " " + prose(draw, 2)
        if i % 5 == 0:  # a passage without an end of sentence
            text += " " + " ".join(draw.choices("abc", k=i)) + " " + run
        rows.append((i, text))
    rows += [(50, rows[0][1]), (51, rows[0][1].upper()), (52, (passage + "\n") * 2), (7, rows[7][1]), (None, rows[0][1]), (None, passage),
             (60, None), (61, ""), (62, " \n\n "), (63, "One."), (64, prose(draw, 1500)), (65, "x " * 3_000)]
    docs = spark.createDataFrame([(*r, 1, 2, "h") for r in rows], DOC)
    got = rs.remove(docs)
    assert got.columns == [*docs.columns, "n_sentences", "n_repeated", "n_removed"]
    found = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(brute(rows), key=str)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[0]["n_repeated"] > 0 == by_id[0]["n_removed"] and by_id[1]["n_repeated"] == 0
    assert by_id[50]["text"] == "" and by_id[50]["n_removed"] == by_id[50]["n_sentences"]
    assert by_id[10]["n_removed"] > 3  # the long run is cut alike behind different words


def test_sentences_equal_plain_ones_in_any_block(monkeypatch):
    draw = random.Random(6)
    texts = [prose(draw, 20), "", "  ", "a", "\n\na.b. c\n \n", "x " * 100, "...", "é… à! 3.14 is. end", "…", "one two\u2003three.\tfour"]
    for most in (1 << 20, 40):
        monkeypatch.setattr(rs, "BYTES_AT_ONCE", most)
        found = []
        for at, part in rs.blocks(texts):
            block = rs.split(part)
            assert at == len(found)
            for i in range(len(part)):
                low, high = block.bounds[i], block.bounds[i + 1]
                inner = [int(f - low) for f in block.first if low <= f < high]
                found.append(list(zip(inner, [*inner[1:], int(high - low)])))
        assert found == [plain_sentences(t)[1] for t in texts]


def test_texts_of_one_id_are_documents_of_their_own(spark):
    draw = random.Random(3)
    one, other = (" ".join(f"{draw.randrange(10**6)}" for _ in range(100)) for _ in range(2))
    rows = [(1, one), (2, one), (2, other), (2, one)]
    got = rs.remove(spark.createDataFrame([(*r, 1, 2, "h") for r in rows], DOC)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, one), (2, ""), (2, other), (2, "")])


def test_empty_table(spark):
    assert rs.remove(spark.createDataFrame([], DOC)).collect() == []


def test_passages_inside_other_text_are_found(spark):
    """A passage of 51 words at a random word of two documents, in sentences of any length and without ends."""
    draw = random.Random(21)

    def text(n):
        return [f"{draw.randrange(10**9)}{draw.choice(['', '', '', '', '.', '.&&&'])}" for _ in range(n)]

    rows, planted = [], {}
    for k in range(300):
        passage = text(51)
        for doc in (2 * k, 2 * k + 1):
            own, at = text(200), draw.randrange(201)
            rows.append((doc, " ".join([*own[:at], *passage, *own[at:]]), 1, 2, "h"))
            planted[doc] = set(passage)
    got = {r["doc_id"]: r for r in rs.remove(spark.createDataFrame(rows, DOC)).collect()}
    left = {doc: len(planted[doc] & set(got[doc]["text"].split())) for doc in planted}
    assert all(left[doc] == 51 and got[doc]["n_removed"] == 0 for doc in planted if doc % 2 == 0)
    later = [doc for doc in planted if doc % 2]
    assert all(len(got[doc]["text"].split()) == 200 + left[doc] for doc in later)  # nothing else goes
    assert sum(left[doc] < 51 for doc in later) >= 0.98 * len(later)
    assert sum(left[doc] for doc in later) / (51 * len(later)) < 0.2
