from tests.llm.test_dedup import words
from tidemark.llm import substring_dedup


def test_an_earlier_document_with_a_part_does_not_hide_a_passage(spark):
    data = []
    for k in range(40):
        passage = words(k, 51)
        part = " ".join(passage.split()[15:35])
        data += [(10 * k, f"{words(1000 + k, 40)} {part} {words(2000 + k, 40)}"), *((10 * k + i, f"{words(3000 + 10 * k + i, 40)} {passage} {words(6000 + 10 * k + i, 40)}") for i in (1, 2))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    alone = docs.where("doc_id % 10 <> 0")

    def covered(frame):
        found = {}
        for r in substring_dedup.repeated_spans(frame).where("doc_id % 10 = 2").collect():
            found.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        return found

    whole, split = covered(alone), covered(docs)
    assert len(whole) == 40 and whole == split


def test_spans_name_their_owner_and_repeat_its_text(spark):
    passage = words(1, 51)
    part = " ".join(passage.split()[:25])
    data = [(0, f"{words(2, 40)} {part} {words(3, 40)}"), *((i, f"{words(10 + i, 40)} {passage} {words(20 + i, 40)}") for i in (1, 2)), (3, f"{words(30, 40)} {' '.join(passage.split()[40:])} {words(31, 40)}")]
    got = substring_dedup.repeated_spans(spark.createDataFrame(data, "doc_id long, text string")).collect()
    texts = dict(data)
    assert {r.keep_id for r in got if r.doc_id == 2} == {0, 1} and 3 not in {r.doc_id for r in got}
    for r in got:
        assert texts[r.doc_id][r.start : r.end] in texts[r.keep_id]
