"""Large integer ids beside null ones come through every operator as they are."""

import pytest

from skyloom.llm.decontam import decontaminate
from skyloom.llm.langid import language_id
from skyloom.llm.licenses import license_scan
from skyloom.llm.packing import pack
from skyloom.llm.simhash import simhash_dedup

BIG = (1 << 60) + 1


@pytest.fixture(scope="module")
def large(spark):
    rows = [(BIG + 2 * k, f"the text number {k} is like no other of them", "en", "s") for k in range(6)]
    rows += [(None, "a text without an id", "de", "s"), (None, None, None, None), (BIG + 20, rows[3][1], "en", "s"), (BIG + 21, "  ", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


def test_simhash(large):
    got = {r.doc_id: r.component_id for r in simhash_dedup(large).filter("doc_id IS NOT NULL").collect()}
    assert got == {BIG + 2 * k: BIG + 2 * k for k in range(6)} | {BIG + 20: BIG + 6, BIG + 21: BIG + 21}


@pytest.mark.parametrize("operator", ["licenses", "langid", "decontam", "packing"])
def test_ids(spark, large, operator):
    import public_tokenizers

    of = {
        "licenses": license_scan,
        "langid": language_id,
        "decontam": lambda d: decontaminate(d, spark.createDataFrame([("i", "no other of them")], "item_id string, text string")),
        "packing": lambda d: pack(d, public_tokenizers.path("word_bpe_49k.json")),
    }[operator]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(of(large)) == ids(large)
