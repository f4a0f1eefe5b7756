import numpy as np
import pyarrow as pa

from veedor.llm import exchange


def test_places_follow_the_values(spark):
    least = exchange.places_for(spark, 0)
    assert least & (least - 1) == 0 and least >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [exchange.places_for(spark, n) for n in (10**7, 10**8, 10**9, 10**10, 10**14)]
    assert sizes == sorted(sizes) and sizes[2] >= 10**9 // exchange.PER_PLACE and sizes[-1] == exchange.MOST_PLACES
    texts = spark.createDataFrame([("abcde " * 1000,), (None,)], "text string")
    assert exchange.words_in(texts) == 1000 and exchange.words_in(texts.limit(0)) == 0


def test_a_partition_may_have_several_places(spark, monkeypatch):
    """Each place is settled once, alone, with all its values, however few partitions there are."""
    values = np.arange(20_000, dtype=np.uint64) * np.uint64(2**64 // 20_000)

    def deal(batches):
        for batch in batches:
            mine = values[np.isin(np.arange(len(values)) % 5, batch.column(0).to_numpy())]
            yield from exchange.dealt(iter([(0, [mine, np.ones(len(mine), np.int64)])]), 64)

    def settle(place, rows):
        h, n = exchange.gathered(rows, {0: ["u8", "i8"]})[0]
        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([len(h)]), pa.array([int((h >> np.uint64(58)).max())]), pa.array([int((h >> np.uint64(58)).min())])], ["place", "n", "most", "least"])

    for most in (4096, 3):
        monkeypatch.setattr(exchange, "MOST_PARTITIONS", most)
        got = exchange.met(spark.range(5).repartition(5).mapInArrow(deal, exchange.ROWS), 64, settle, "place long, n long, most long, least long").collect()
        assert sorted(r.place for r in got) == list(range(64)) and sum(r.n for r in got) == len(values)
        assert all(r.most == r.least == r.place for r in got)
