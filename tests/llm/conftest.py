import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

LINE = "Shared line of this host that stands in many of its pages today."
BODY = " ".join(f"word{k} other{k * 7 % 31}" for k in range(60))

# Null in any column, empty and very long texts, ties, repeated rows, odd characters.
EDGES = [
    (10_000, None, "en", "src1", None),
    (10_001, "", None, None, 0),
    (10_002, " \n\t ", "en", "src1", 4),
    (None, "A text without an id.", "en", "src1", 21),
    (10_003, "one two", "en", None, 7),
    (10_004, "one two", "en", None, 7),
    (10_005, "one two", "en", None, 7),
    (10_005, "one two", "en", None, 7),
    (10_006, "x" * 5000 + " " + "Ünï ςΣ İ ǅ é\x1c.\x85z " * 40, "de", "src2", 6000),
    (10_007, ("many words go round and round here. " * 3000).strip(), "en", "src2", 100_000),
    (10_008, "<|endoftext|> it's 12.5 A.,. B÷. don't., 日本語のテキスト", "ja", "src3", 50),
    (10_009, "a b c a b c a b c\nsame line\nsame line\n\n same line", "en", "src3", 40),
    *[(11_000 + k, f"{LINE}\n{BODY} extra{k} more{k}", "en", "blog", 900) for k in range(30)],
    *[(11_100 + k, f"{LINE}\nshort {k}", "en", "blog", 70) for k in range(5)],
    *[(11_200 + k, f"{BODY} tail{k}", "en", f"src{k % 5}", 800) for k in range(12)],
]


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents and the edge cases, with columns that operators use themselves."""
    table = pq.read_table(f"{SF_DIR}/documents.parquet").to_pandas()
    rows = [tuple(None if pd.isna(x) else x for x in row) for row in table.itertuples(index=False)]
    rows = [(int(a), b, c, d, int(e)) for a, b, c, d, e in rows] + EDGES
    made = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("key", "n_words", "spans", "row", "rest", "fingerprint", "shard", "part", "line", "text_hash"):
        made = made.selectExpr("*", f"doc_id as {name}")
    return made.repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def doc_rows(documents):
    return [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="session")
def items(spark):
    rows = pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()
    more = [(900, "one two"), (901, None), (902, ""), (None, "go round and round"), (903, "word0 other0 word1 other7")]
    return spark.createDataFrame([(r["item_id"], r["text"]) for r in rows] + more, "item_id long, text string")


@pytest.fixture(scope="session")
def tables(tmp_path_factory, documents, items):
    """A folder like those of the test data, with the documents of these tests."""
    folder = str(tmp_path_factory.mktemp("tables"))
    documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    for name in ("labels", "conversations", "embeddings"):
        pq.write_table(pq.read_table(f"{SF_DIR}/{name}.parquet"), f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="session")
def no_tables(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    pq.write_table(pa.schema(kinds.items()).empty_table(), f"{folder}/documents.parquet")
    pq.write_table(pa.schema([("item_id", pa.int64()), ("text", pa.string())]).empty_table(), f"{folder}/benchmark.parquet")
    labels = [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]
    pq.write_table(pa.schema(labels).empty_table(), f"{folder}/labels.parquet")
    for name in ("conversations", "embeddings"):
        pq.write_table(pq.read_schema(f"{SF_DIR}/{name}.parquet").empty_table(), f"{folder}/{name}.parquet")
    return folder
