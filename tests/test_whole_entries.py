from trackloom.plans import queries


def test_review_of_every_open_entry(spark, tmp_path):
    """Every entry that ends without a file has its best files told, whatever its id."""
    lib = "flac_id long, path string, norm string"
    spark.createDataFrame([(1, "/m/Ann/Blue/01 - Red Sky.flac", "red sky"), (2, "/m/Bob/Grey/02 - Cold Wind.flac", "cold wind")], lib).write.parquet(f"{tmp_path}/flacs.parquet")
    asked = [(7, "Nobody - Red Sea"), (100, "Nobody - Cold Sea"), (101, "Nobody - Blue Wind"), (102, "Red Sky")]
    spark.createDataFrame([(i, f'{{"title": "{t}"}}') for i, t in asked], "match_id long, query_track string").write.parquet(f"{tmp_path}/matches.parquet")
    out = [(r["track"], r["rank"]) for r in queries.review_entries(spark, str(tmp_path)).collect()]
    assert sorted(out) == sorted((t, rank) for i, t in asked if i != 102 for rank in (1, 2))
