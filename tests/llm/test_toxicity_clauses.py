"""Attacks at somebody, denied and reported ones, and ordinary sentences, by grammars fitted on two sizes of table."""

import pytest

from shelfwise.llm import toxicity

ATTACKS = [
    "I will kill you.", "You are a total idiot", "Du bist ein Idiot", "Ich werde dich töten", "te voy a matar", "je vais te tuer", "eres un idiota", "tu es un crétin", "You pathetic loser, nobody wants you here.",
    "You stupid moron!", "idiot, you have no idea", "We will burn you and destroy you",
]
HARMLESS = [
    "you are not stupid", "He said you are an idiot", "Du bist kein Idiot", "Take the path along the river.", "Das Wort des Jahres ist ein schönes Wort.", "He is worthy of the prize.", "Trash day is Monday.", "The fire will destroy the house.",
]
CLEAN = """The path through the woods is closed until spring.|Worthy causes need steady support.|My sister will beat the eggs before adding flour.|They attack the problem from a new side.|We lose an hour when the clocks change.|A closer look shows the error.
|The clown made the children laugh.|Please take out the trash before nine.|Disguise the wires behind the desk.|Study the map and follow the signs.|The moroccan tea was sweet.|You can shoot the photo at sunset.|Our team will play again on Sunday.
|The doctor said the burn would heal.|Your stupendous garden won a prize.|Losing weight takes time.|The idiom is hard to translate.|You should try the soup.|Closing the account takes a day.|Nobody was hurt in the storm.|The patterns on the path repeat.
|Das Wort steht nicht im Buch.|Die Antwort ist kurz.|Wir werden das Haus verkaufen.|Der Wortschatz wächst jeden Tag.|Du bist heute früh dran.|Ihr müsst die Fenster schließen.|Er wird die Sahne schlagen.|Ich möchte dich am Montag besuchen.|Die Pfade im Park sind neu.|Morgen fahren wir ans Meer.
|La palabra es muy antigua.|Voy a quemar la leña esta noche.|El camino está cerrado.|Tu hermana llega mañana.|Te llamo después de comer.|La paella está muy buena.|Vamos a golpear la piñata.|Ellos quieren comprar pan.|El perdedor saludó al ganador.|No te olvides del libro.
|Le chemin est fermé pour travaux.|Je vais brûler les vieux papiers.|Tu es en avance ce matin.|Vous êtes les bienvenus.|La pâte doit reposer une heure.|Nous allons frapper à la porte.|Elle a dit que le train part à midi.|Le clown fait rire les enfants.|Je te rends ton livre demain.|Les mots du texte sont simples.""".replace("\n", "").split("|")


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_clauses_decide(spark, size):
    documents, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.fit_toxicity(documents, labels)
    texts = ATTACKS + HARMLESS + CLEAN
    assert len(CLEAN) >= 50
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), grammar).collect()}
    assert [t for i, t in enumerate(texts) if got[i].predicted != (i < len(ATTACKS))] == []
    score = {t: got[i].score for i, t in enumerate(texts)}
    # a stronger clause never scores lower, and what is denied or reported counts nothing
    assert score["I will kill you."] > score["The fire will destroy the house."]
    assert score["you are not stupid"] == score["He said you are an idiot"] == min(score.values())
    assert all(c >= 0 for c in grammar.coefficients[1:])
    assert all(whole or len(a) >= 5 for a, whole, _ in grammar.arcs)
    scored = toxicity.score_toxicity(documents, grammar).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    count = {(r.toxic, r.predicted): r["count"] for r in scored}
    assert count.get((0, 1), 0) == 0 and count[1, 1] >= (0.85 if size == "sf0.1" else 0.6) * (count[1, 1] + count.get((1, 0), 0))


def test_without_labels_the_examples_decide(spark):
    grammar = toxicity.fit_toxicity(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score_toxicity(spark.createDataFrame([(1, "You are an idiot"), (2, "A nice day"), (3, None)], "doc_id long, text string"), grammar).orderBy("doc_id").collect()
    assert [r.predicted for r in rows] == [1, 0, 0] and rows[1].score == rows[2].score
