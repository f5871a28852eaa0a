"""Sentences, splitting, alignment, defects: by hand, by properties and on odd input."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ragloom.llm import alignment, answer_checks, defects, sentences, splitting


def cut(text, language):
    return [text[a:b] for a, b in sentences.units(text, language)]


@pytest.mark.parametrize("language,parts", [
    ("en", ["Dr. Lee saw 3.5 mg at 7 p.m. Monday.", "“Stop! Go!” shouted Mr. Ross.", "He wrote: “It holds.”", "Costs fell by .71 percent.", "(No reason.)", "Why?!", "It was long... and failed."]),
    ("en", ["Prices at Halm & Co. Ltd. fell.", "J. R. Tolm of St. Ombra signed.", "See Fig. 2 and Sec. 4.1 there.", "The file a.csv (v1.2) is here."]),
    ("de", ["Am 3. März kam Dr. Braun.", "„Bitte warten. Wir öffnen um 1 Uhr“, sagte sie.", "Nr. 1 und Nr. 2 fehlen, d. h. alle."]),
    ("fr", ["Évitez la forêt !", "M. Dunmore est arrivé à 5 h.", "« Attendez. Revenez », dit-elle.", "Voir p. 1 et fig. 2 ici."]),
    ("kr", ["물은 3.5도다.", "“더는 없다.”라는 쪽지를 남겼다.", "2024. 6. 25. 문을 열었다.", "기다림은 길었지만... 결국 멈췄다.", "왜 그랬을까?!", "아직 끝나지 않았어요…"]),
    ("hi", ["डॉ. वेल्सन आए।", "नर्स ने कहा, “रुकिए। फिर आइए।”", "क्या पानी साफ है?"]),
])
def test_spaced_languages(language, parts):
    assert cut(" ".join(parts), language) == parts
    assert cut("\n\n".join(parts), language) == parts


@pytest.mark.parametrize("language,parts", [
    ("ja", ["試料No. 8は届かなかった．", "「冷やすこと。記録すること。」と彼は言った。", "本当か？！", "（図6を参照。）"]),
    ("zh", ["护士说：“请等。不要开门。”", "医生写下“先洗手。再记录。”后离开了。", "他们等了31天……但没有结果。"]),
])
def test_unspaced_languages(language, parts):
    assert cut("".join(parts), language) == parts


def test_layout():
    assert cut("Methods\r\n\r\nOne line that\nis wrapped. Next.\n- first item\n2. second item.\n• third", "en") == [
        "Methods", "One line that\nis wrapped.", "Next.", "- first item", "2. second item.", "• third"]
    assert cut("처음 문장이 끝났다 다음 문장도 끝났습니다 휴식보다 낫다", "kr") == ["처음 문장이 끝났다", "다음 문장도 끝났습니다", "휴식보다 낫다"]
    assert cut("ชาวบ้านรอเรือ  พบร้อยละ 3.5 ของตัวอย่าง", "th") == ["ชาวบ้านรอเรือ", "พบร้อยละ 3.5 ของตัวอย่าง"]
    assert cut("An unclosed “mark here. Still cut.", "en") == ["An unclosed “mark here.", "Still cut."]
    assert cut("Ends here.Starts there.", "en") == ["Ends here.", "Starts there."]


def test_units_tile_the_text_and_stay_linear():
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(["Dr. ", "a", " ", ".", "”", "“", "。", "\n", "다 ", "3", "\"", "…", "　", "！", "é"]) for _ in range(rng.randrange(80)))
        for language in ("en", "kr", "ja", "zh", "th", "hi", "fr", "de", None):
            units = sentences.units(text, language)
            assert all(text[a:b] == text[a:b].strip() != "" for a, b in units)
            gaps = [0, *[x for u in units for x in u], len(text)]
            assert all(not text[gaps[i]:gaps[i + 1]].strip() for i in range(0, len(gaps), 2))
    for long in ("." * 200_000, " " * 200_000 + "x", "\"" * 200_000, "a" * 300_000, "「" * 100_000, "“" * 100_000 + "."):
        began = time.time()
        for language in ("en", "ja", "zh"):
            sentences.units(long, language)
        assert time.time() - began < 20


def test_sentence_query_on_odd_rows(spark):
    df = spark.createDataFrame([("a", None, "en", 1), ("b", "", "en", 1), ("c", " \n\t", None, 1), ("d", "One. Two.", None, 1), ("d2", "One.", "xx", 2)],
                               "id string, content string, language string, start_idx int")
    got = sentences.sentence_units(df, "id", "content", "language").orderBy("id", "start_idx").collect()
    assert [tuple(r) for r in got] == [("d", 0, 4), ("d", 5, 9), ("d2", 0, 4)]
    assert sentences.sentence_units(df.limit(0), "id", "content", "language").count() == 0


def test_pieces_hold_their_limits():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["word", " ", ". ", "\n\n", "x" * rng.randrange(60), "다. ", "。", ", "]) for _ in range(rng.randrange(1, 300)))
        limit = rng.randrange(10, 200)
        overlap = rng.randrange(0, (limit + 1) // 2)
        found = splitting.split(text, limit, overlap)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in found) or text == ""
        assert all(x[1] - overlap == y[0] for x, y in zip(found, found[1:]))
        assert len(found) >= splitting.least_pieces(len(text), limit, overlap)
        assert not any(splitting.boundary_faults(text, a, b) and any(c.isspace() for c in text[max(a + overlap, a + (b - a) // 2):b]) for a, b in found)
    assert splitting.split("", 10, 2) == [(0, 0)]
    assert max(b - a for a, b in splitting.split("x" * 5000, 512, 51)) <= 512
    with pytest.raises(ValueError):
        splitting.split("abc", 4, 2)


CHUNK = "chunk_id string, document_id string, strategy string, sequence_num int, start_idx int, end_idx int, content string"


def test_audit(spark):
    text = "alpha beta gamma delta"
    rows = [("ok", "d", "s", 0, 0, 11, text[0:11]), ("ok", "d", "s", 0, 0, 11, text[0:11]), ("mid", "d", "s", 1, 8, 19, text[8:19]), ("lap", "d", "s", 2, 18, 22, text[18:22]),
            ("big", "d", "t", 0, 0, 22, text), ("con", "d", "t", 1, 21, 22, "z"), ("none", "d", "t", 2, 21, 22, None), ("lost", "q", "s", 0, 0, 1, "a"), ("new", "d", "u", 0, 0, 3, "alp")]
    docs = spark.createDataFrame([("d", text, 5), ("e", None, 6)], "document_id string, content string, sequence_num int")
    specs = spark.createDataFrame([("s", 12, 3), ("t", 20, 1)], "strategy string, size_limit int, overlap int")
    got = {tuple(r) for r in splitting.audit(spark.createDataFrame(rows, CHUNK), docs, specs).collect()}
    assert got == {("mid", "midword"), ("lap", "overlap"), ("big", "oversize"), ("con", "content"), ("none", "content"), ("lost", "content")}
    assert splitting.audit(spark.createDataFrame([], CHUNK), docs, specs).count() == 0


def test_split_query(spark):
    df = spark.createDataFrame([("a", "word " * 100, 50, 5), ("b", None, 50, 5), ("c", "short", 50, 0)], "id string, t string, n int, o int")
    got = splitting.pieces(df, ["id"], "t", "n", "o").orderBy("piece").collect()
    assert {r["id"] for r in got} == {"a"} and all(len(r["content"]) <= 50 for r in got)


EN = ["The cooling tank must be cleaned every {} hours.", "Nurse Tolm advised dock workers to rest for {} days.", "The budget for grey lung rose by {}% in June.",
      "Volunteers from Ombra carried {} masks to the clinic.", "The pump at Sable Ford failed after {} hours of use."]
KR = ["냉각조는 {}시간마다 닦아야 한다.", "톨름 간호사는 부두 노동자들에게 {}일 동안 쉬라고 권고했다.", "회색폐병 예산은 6월에 {}% 늘었다.", "옴브라의 자원봉사자들은 마스크 {}장을 진료소에 전달했다.",
      "세이블 여울의 펌프는 {}시간 사용한 뒤 고장 났다."]
LEXICON = [("Nurse Tolm", "톨름 간호사"), ("grey lung", "회색폐병"), ("Ombra", "옴브라"), ("masks", "마스크"), ("dock workers", "부두 노동자들"), ("hours", "시간"), ("days", "일")]
DOCS = "document_id string, content string, language string, original_id string, line_num int"


def translated(n=60):
    rng = random.Random(5)
    rows, truth = [], set()
    for d in range(n):
        left, right, order = [], [], rng.sample(range(5), 5)
        for k in order:
            x = rng.randrange(10, 90_000)
            left.append(EN[k].format(f"{x:,}"))
            right.append(KR[k].format(x))
        rights, where = [], {}
        for i, line in enumerate(right):
            if i == 1 and d % 3 == 0:
                continue  # left out
            if i == 3 and d % 2:
                rights[-1] = rights[-1].rstrip(".다") + "고, " + line
            else:
                rights.append(line)
            where[i] = len(rights) - 1
        if d % 4 == 0:
            rights.insert(1, "")
            where = {i: j + (j >= 1) for i, j in where.items()}
        rows += [(f"o{d:03d}", "\n".join(left), "en", None, 0), (f"o{d:03d}_kr", "\r\n".join(rights), "kr", f"o{d:03d}", 0)]
        truth |= {(f"o{d:03d}", i, f"o{d:03d}_kr", j) for i, j in where.items()}
    return rows, truth


def test_alignment_sent_and_joined_tables(spark):
    rows, truth = translated()
    odd = [("n1", None, "en", None, 0), ("n1_kr", "한 줄", "kr", "n1", 0), ("n2", "", "en", None, 0), ("x_kr", "줄", "kr", "missing", 0), ("n3_kr", None, "kr", "o000", 0), rows[0]]
    docs = spark.createDataFrame(rows + odd, DOCS)
    lexicon = spark.createDataFrame(LEXICON + [(None, "없음")], "term_en string, term_kr string")
    got = {tuple(r) for r in alignment.aligned_lines(docs, lexicon).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)
    assert {tuple(r) for r in alignment.aligned_lines(docs, lexicon, sent_rows=0).collect()} == got
    assert alignment.aligned_lines(docs.limit(0), lexicon).count() == 0


def test_numbers():
    assert alignment.close(94.15, 94) == 0.8 and alignment.close(1000, 1000.0) == 1.0 and alignment.close(5, 6) == 0.0
    assert alignment.words("6월 이후 1,000명", "kr") == (["6월", "이후", "명"], [1000.0])


Q = "Why did the Water Office close its ward in June?"


@pytest.mark.parametrize("answer,want", [
    (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("<answer></answer>", "empty"), ("N/A", "empty"), ("없음.", "empty"), ("...", "empty"), ("Answer: -", "empty"),
    (Q, "copied"), (Q.upper(), "copied"), (f"You asked: {Q}", "copied"), (f"{Q} {Q}", "copied"), (f"> {Q}", "copied"), (f"{Q} It had no water.", None),
    ("I'm sorry, but I can't answer that.", "refusal"), ("Based on passage 2: I don't know.", "refusal"), ("Sorry news came: 5 samples were lost and the office refused a test.", None),
    ("No. They cannot take it.", None), ("Die Klinik meldete 12 Fälle und schloss danach die Station.", "wrong_language"), ("직원이 모두 아팠기 때문이다.", "wrong_language"),
    ("It closed because (for example", "truncated"), ("It closed because of \"", "truncated"), ("It closed for:\n1. wash\n2.", "truncated"), ("```\ncode", "truncated"),
    ("It closed because of the fever,", "truncated"), ("**It** closed (see Fig. 2).", None), ("<b>It closed.</b>", None), ("<b>It closed.", "truncated"), ("- one\n- two", None),
])
def test_visible_defects(answer, want):
    assert defects.visible_defect(Q, "en", answer) == want


def test_other_language_words_and_unknown_questions():
    assert defects.visible_defect("회색폐병의 영어 이름은 무엇인가요?", "kr", "Grey lung") is None
    assert defects.visible_defect("What is the Korean name of grey lung?", "en", "It is called 회색폐병.") is None
    assert defects.visible_defect(None, None, "Anything at all.") is None


def test_tiling_covers_moved_runs():
    assert answer_checks.tiles("d e f a b c".split(), "a b c d e f".split()) == 6
    assert answer_checks.tiles("a b x c d".split(), "a b c d".split()) == 0
    began = time.time()
    answer_checks.is_copied("a b c d", "a b c d " * 20_000)
    assert time.time() - began < 20


def test_cut_off_words(spark):
    full = "The office recorded {} cases of fever during the winter, most of them among workers"
    queries = spark.createDataFrame([("q", Q, "en", "Because of fever")] * 2, "query_id string, question string, language string, expected_answer string")
    rows = [(f"r{i}", "q", full.format(i) + ".") for i in range(60)] + [("cut1", "q", "The office recorded 5 cases of"), ("cut2", "q", "The office recorded 5 cases of fever duri"),
            ("fine", "q", full.format(3)), ("null", "missing", None), *[(f"short{i}", "q", "Because of fever") for i in range(20)], ("fine", "q", full.format(3))]
    responses = spark.createDataFrame(rows, "response_id string, query_id string, response string").withColumn("question", F.lit("clash"))
    got = {tuple(r) for r in defects.defects(defects.answer_pairs(queries, responses)).collect()}
    assert got == {("response", "cut1", "truncated"), ("response", "cut2", "truncated"), ("response", "null", "empty")}
    assert defects.defects(defects.answer_pairs(queries.limit(0), responses.limit(0))).count() == 0


def test_alignment_scores_every_line_that_shares_something():
    right = [f"9 11 21 19 gamma{i}" for i in range(8)] + ["alpha beta 10 20"]
    side = [alignment.Side(t, "en", lambda w: 3.0) for t in ("alpha beta 10 20", "\n".join(right))]
    pair = alignment.Pair(*side, {}, {})
    assert pair.candidates() == ({0: set(range(9))}, {j: {0} for j in range(9)})
    assert pair.align() == [(0, 8)]


def test_alignment_joined_table_has_the_weights_of_all_words(spark, monkeypatch):
    # The right line also says "t1 t2", common words (weight 0.3) without a link to this left document.
    table = [("l1", "r1", 0.9, 3.0, 3.0), ("l2", "r2", 0.9, 3.0, 3.0), ("other", "t1", 0.9, 3.0, 0.3), ("other", "t2", 0.8, 3.0, 0.3)]
    learned = spark.createDataFrame([(*(x.translate(str.maketrans("12", "xy")) for x in r[:2]), *r[2:]) for r in table],
                                    "s string, t string, dice double, weight_s double, weight_t double")
    monkeypatch.setattr(alignment, "translation_table", lambda pairs, terms: learned)
    pairs = spark.createDataFrame([("a", "b", "lx ly unsaid unheard", "rx ry tx ty", "en", "kr"), ("c", "d", "lx ly", "rx ry tx ty", "en", "kr")],
                                  "left_id string, right_id string, left_text string, right_text string, left_lang string, right_lang string")
    sent, joined = ({tuple(r) for r in alignment.align(pairs, [], n).collect()} for n in (10, 0))
    assert sent == joined == {("a", "b", 0, 0), ("c", "d", 0, 0)}


@pytest.mark.parametrize("answer,refuses", [
    ("I'm afraid I can't help with that.", True), ("I am afraid that I cannot answer this.", True), ("That is not something I can help with.", True), ("I have no idea.", True),
    ("No clue, sorry.", True), ("I wish I could tell you, but I can't.", True), ("We're unable to provide this.", True), ("The passage gives no answer to that.", True),
    ("Das kann ich leider nicht beantworten.", True), ("Ich weiß es nicht.", True), ("Je ne peux pas répondre à cette question.", True),
    ("申し訳ありませんが、お答えできません。", True), ("抱歉，我无法回答这个问题。", True), ("This cannot be determined from the context.", True),
    ("Patients cannot be determined from age.", False), ("Patients cannot help coughing.", False), ("No idea was better than rest.", False),
    ("We found that the clinic cannot provide beds.", False), ("Unfortunately the clinic closed.", False)])
def test_refusals(answer, refuses):
    assert answer_checks.is_refusal("q?", answer) is refuses


def test_answers_in_another_latin_language():
    assert answer_checks.is_wrong_language("Wie lange soll man sich ausruhen?", "de", "The patient should rest for six days in bed.")
    assert answer_checks.is_wrong_language("How long should one rest?", "en", "De patiënt moet zes dagen in het bed blijven en niet opstaan.")
    assert not answer_checks.is_wrong_language("How long should one rest?", "en", "Six days")


def test_long_tokens_stay_linear(spark):
    kind = "side string, id string, question string, language string, answer string"
    took = []
    for size in (100, 100, 40_000):
        df = spark.createDataFrame([("query", str(i), "what is it", "en", "x" * (size + i)) for i in range(3)] + [("query", "e", "why", "en", None)], kind)
        began = time.time()
        assert {r["id"]: r["defect"] for r in defects.defects(df).collect()}["e"] == "empty"
        took.append(time.time() - began)
    assert took[2] < took[1] + 5, took


def test_pieces_are_few_balanced_and_fast():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 10))) for _ in range(500)]
    text = "".join(rng.choice(words) + (rng.choice([". ", ", ", "\n\n"]) if rng.random() < 0.1 else " ") for _ in range(36_000))
    began = time.time()
    found = splitting.split(text, 200, 50)
    assert time.time() - began < 5
    assert len(found) <= 1.05 * splitting.least_pieces(len(text), 200, 50)
    assert not any(splitting.boundary_faults(text, a, b) for a, b in found)
    slashes = "/".join(words * 30)
    for limit in (4000, 9000, 20_000):
        assert not any(splitting.inside_word(slashes[b - 1], slashes[b]) for _, b in splitting.split(slashes, limit)[:-1])
