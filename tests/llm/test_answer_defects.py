import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.llm import answer_defects as ad

Q = "Which duty applies to woven jute mats from Norburg?"
PAIRS = pq.read_table("/root/testdata/sf0.01/advisories.parquet", columns=["query", "short_answer", "reasoning"]).to_pylist()
MODELS = ad.fit_languages((r["query"], r["short_answer"], r["reasoning"]) for r in PAIRS)


def defect(*texts):
    return ad.defect(*texts, MODELS)


GOOD = "The duty on woven jute mats is 5 percent in the district of Norburg."


@pytest.mark.parametrize("text", [None, "", " \n", "N/A", "none", "{}", '""', "...", "-", " "])
def test_empty(text):
    assert defect(Q, text, GOOD) == defect(Q, GOOD, text) == "empty"


@pytest.mark.parametrize("text", [
    "I'm sorry, but I can't help with that request.", "My guidelines do not permit a reply to this.",
    "Thank you for asking. That said, I would rather not give a view here; please consult a professional.",
    "No answer will be given here; kindly put the matter to a broker.", "Diese Frage darf ich nicht beantworten.",
    "Je suis désolé, je ne peux pas répondre à cette demande.", "Lo siento, no puedo ayudar con esa consulta.", "क्षमा करें, मैं इस प्रश्न का उत्तर नहीं दे सकता।",
    "We are not authorised to comment on this.", "I won't answer that.", "Our policy does not allow me to give legal advice.", "I have to refuse this request.", "Dabei kann ich Ihnen leider nicht weiterhelfen.",
    "Je ne suis pas en mesure de donner un avis.", "No podemos ofrecer asesoramiento sobre este punto."])
def test_refusal(text):
    assert defect(Q, text, GOOD) == "refusal"


@pytest.mark.parametrize("text", [
    GOOD, "The office refused the claim of Marl Imports and cannot reopen it before 3 May 2019.", "The sources do not state a rate for jute mats.",
    "Norburg Mills is not able to use the relief, since mats need a permit.", "The local text calls them «moteurs électriques».",
    "The mats were declined, so the heading is 4413.93.36", "The rate is 5 percent (see heading 5785.46)", Q + " " + GOOD,
    "The interval [0, 1) holds all rates.", "Rates lie in (2, 5], as stated.", "I can't stress enough that this question is settled: the duty is owed.",
    "We may not import it without the advice of the board.", "I cannot help noticing that the answer is in the schedule.", "We do not give the board's opinion any weight.",
    "The board can't answer this request before May.", "My guidelines are the rules of the board, and they do not help the importer.", "No answer was given by the board.",
    "We could not find this request in the register.", "It is not possible for the importer to reply.", "He said: \"I cannot answer this question.\"",
    "<b>The duty</b> is **5 percent**<br> and no more.", "a) The mats are woven. b) The duty is owed.",
    "Three steps apply:\n- file form A\n- pay the duty\n- collect the goods", "See ```\nx = (1\n``` for the rule."])
def test_fine(text):
    assert defect(Q, text, GOOD) is None


@pytest.mark.parametrize("text", [Q, Q.upper(), "Question: " + Q, f'"{Q}"', Q + " " + Q, Q.rstrip("?").replace(" ", "  ")])
def test_copied(text):
    assert defect(Q, text, GOOD) == "copied_query"


@pytest.mark.parametrize("text", [
    "Die Firma Marl and Söhne hat Kugellager in Norburg angemeldet und 497 hinterlegt.", "La oficina de Norburg clasifica los cables en la partida 5817 y no los hilos.",
    "Yeh maal Norburg ke karyalay ke anusaar 6673 mein rakha jata hai, isliye chhoot nahin milegi.", "खंड 3 के अनुसार माल का लेखा रखना होगा।"])
def test_other_language(text):
    assert defect(Q, text, GOOD) == "other_language"


@pytest.mark.parametrize("text", [
    "The duty on woven jute", "The duty is owed, as in the case of", "The proper officer at serial (see", "The rate is 5 percent (see heading 57",
    "He said \"the duty is 5 percent.", "```json\n{\"a\": 1", "The rate applies to mats of mixed,", "The rate is set...",
    "The rate lies in [0, 1", "The rate is **5 percent.", "<b>The rate is 5 percent."])
def test_truncated(text):
    assert defect(Q, text, GOOD) == "truncated"


def test_table(spark):
    schema = "session_id string, query string, short_answer string, reasoning string, id string, rank int"
    rows = [("a", Q, "", GOOD, "x", 1), ("a", Q, "", GOOD, "x", 1), ("b", None, GOOD, GOOD, "x", 1), (None, Q, "", "", "x", 1), ("c", Q, GOOD, None, "x", 1),
            ("d", "", "The duty on", GOOD, "x", 1), ("e", Q, GOOD * 3000, GOOD, "x", 1), ("f", Q, "The duty", GOOD, "", 0), ("f", Q, "", GOOD, "", 0)]
    got = {tuple(r) for r in ad.find_defects(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "empty"), ("c", "empty"), ("d", "truncated"), ("f", "empty")}
    assert ad.find_defects(spark.createDataFrame([], schema)).count() == 0


def test_tiles_have_no_gaps():
    query = "a b c d e f g h".split()
    assert ad.tiled(query, query) == 8 and ad.tiled(query, "a b x c d x e f".split()) == 0
    # two words on either side of a longer tile are no tile
    assert ad.tiled("p q a b c d r s".split() + ["z"] + "b c d x p q".split(), "a b c d".split()) == 4


def test_language_models_without_pairs():
    models = ad.fit_languages([])
    assert models.best(["der", "und", "die"]) == "de" and models.best(["xyz"]) is None and not models.differs(None, ["der", "und"])


def test_languages_on_held_out_pairs():
    models = ad.fit_languages((r["query"], r["short_answer"], r["reasoning"]) for r in PAIRS[::2])
    told = [models.best(ad.plain_words(r["query"].lower())) for r in PAIRS[1::2]]
    assert all(told) and {"en", "de", "fr", "es", "hi"} == set(told)
    # an answer's language is its query's but for some three in a hundred
    same = [models.differs(q, ad.plain_words(r["reasoning"])) for q, r in zip(told, PAIRS[1::2]) if r["reasoning"] and len(r["reasoning"]) > 80]
    assert sum(same) < 0.06 * len(same)


def test_models_of_all_pairs(spark):
    # rows of the least id hashes, as many as a sample had, say nothing of any language
    ids = [r["id"] for r in spark.range(3000 + len(PAIRS)).select(F.col("id").cast("string").alias("id")).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, None, GOOD, GOOD) for i in ids[:3000]] + [(i, r["query"], r["short_answer"], r["reasoning"]) for i, r in zip(ids[3000:], PAIRS)]
    table = spark.createDataFrame(rows, "session_id string, query string, short_answer string, reasoning string").repartition(3)
    models = ad.fit_table(table)
    assert (models.logs, models.known, models.trigrams) == (MODELS.logs, MODELS.known, MODELS.trigrams)
    assert {tuple(r) for r in ad.find_defects(table).collect()} == {(i, d) for i, *texts in rows if (d := defect(*texts))}
