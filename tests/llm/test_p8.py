"""p8_found and p8_restored over texts garbled here and over the test data."""

from __future__ import annotations

import __spark_entry__ as e

PROPER = "Die Übertragung der Gebührenordnung für Schüler wird geprüft."
SF = "/root/testdata/sf0.01"


def test_garbled_texts_are_found_and_restored(spark, tmp_path) -> None:  # noqa: ANN001
    wrong = {
        2: PROPER.encode().decode("cp1252"),
        3: PROPER.encode().decode("latin-1"),
        4: f"{PROPER} " * 20 + PROPER.encode().decode("latin-1"),
    }
    rows = [(1, PROPER), *wrong.items(), (5, None), (6, ""), (7, "plain")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = e.queries()["p8_found"](spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint")]
    assert sorted(r.doc_id for r in found.collect()) == [2, 3, 4]
    restored = {r.doc_id: (r.restored, r.fixed) for r in e.queries()["p8_restored"](spark, str(tmp_path)).collect()}
    assert restored == {2: (True, PROPER), 3: (True, PROPER), 4: (True, f"{PROPER} " * 20 + PROPER)}


def test_all_documents_are_examined(spark) -> None:  # noqa: ANN001
    from tessera.llm import garble

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(r.doc_id for r in docs if garble.examine(r.text)[0])
    assert want
    assert sorted(r.doc_id for r in e.queries()["p8_found"](spark, SF).collect()) == want
    assert sorted(r.doc_id for r in e.queries()["p8_restored"](spark, SF).collect()) == want


CLEAN = (
    "El niño comió en España; ¿qué pasó?", "її мова і ґанок", "5 µm and 3‰ of 20 € – “so” said Zoë", "Příliš žluťoučký kůň úpěl ďábelské ódy",
    "Türkçe ığüşöç İstanbul'da", "Þetta er íslenska: ðæöþ", "Ђорђе Његош чачак", "Ελληνικά κείμενα", "Gżegżółka łódź", "Årsrapport på nynorsk: æøå",
    "Őrült árvíztűrő tükörfúrógép", "Māori reo ō tātou", "日本語のテキスト", "Việt Nam đẹp lắm", "Română: țară și școală", "Lietuvių žąsų ėjimas",
    "Latviešu ķēniņš", "עברית שלום", "العربية", "Беларуская ўчора і ёсць", "Русский подъезд", "L’Œuvre d’été à Sète", "coração, pêssego", "§ 5 Abs. 2, 30 °C, 5 × 3 m², ½ l",
)


def test_correct_texts_stay_as_they_are() -> None:
    from tessera.llm import garble

    assert [t for t in CLEAN if garble.examine(t)[0]] == []


def test_utf8_taken_for_any_encoding_is_found_and_mostly_restored() -> None:
    from tessera.llm import garble

    text = "École française: les élèves étudient, où étés et naïveté aident. Gebühren für Größe."
    found = exact = cases = 0
    for taken in garble.ORDER:
        wrong = garble.misread(text, "utf-8", taken)
        if wrong:
            cases += 1
            hit, _, fixed, _ = garble.examine(wrong)
            found += hit
            exact += fixed == text
    assert cases > 25 and found == cases and exact >= 0.9 * cases


def test_long_text_with_one_garbled_word_keeps_the_rest() -> None:
    from tessera.llm import garble

    good = "Die Übertragung für Schüler – “wichtig” – kostet 5 €.\n" * 2000
    assert garble.examine(good + "GebÃ¼hren")[:3] == (True, True, good + "Gebühren")
