from parlance.operators import merging

ENTITIES = [
    (1, "Apple", "business", None), (2, "Apple Inc.", "business", None), (3, "apple", "concept", None), (4, "Old Apple", "business", 1), (5, "Fifth", "person", None),
    (6, "Apple Incorporated", "business", 2), (7, "President Kim Roe", "person", None), (8, "Kim", "person", None), (9, "People: Solo", "concept", None), (10, "Taken Ltd", "organization", None),
    (11, "TAKEN", "organization", 5), (12, None, "person", None), (13, "", "person", None), (14, "“Quoted”", "concept", None), (15, "people: solo", "event", 8),
]
MENTIONS = [1, 2, 2, 2, 3, 7, 8, 8, 10]


def run(spark, accepted=None):
    entities = spark.createDataFrame(ENTITIES, "id long, name string, entity_type string, canonical_id long")
    mentions = spark.createDataFrame([(i, 100 + k) for k, i in enumerate(MENTIONS)], "raw_id long, mention_id long")
    pairs = None if accepted is None else spark.createDataFrame(accepted, "a long, b long")
    return entities, mentions, merging.merge_entities(entities, mentions, pairs)


def table(df):
    return {r["id"]: (r["name"], r["canonical_id"]) for r in df.collect()}


def test_names_winners_and_renames(spark):
    entities, mentions, done = run(spark)
    after = table(done.entities)
    # 2 wins by mentions and changes names with 1, whose name it normalises to
    assert after[2] == ("Apple", None) and after[1] == ("Apple Inc.", 2) and after[3] == ("apple", 2)
    assert after[4] == ("Old Apple", 2) and after[6] == ("Apple Incorporated", 2)  # what pointed to a merged one
    assert after[7] == ("Kim Roe", None) and after[8] == ("Kim", None)
    assert after[9] == ("Solo", None) and after[15] == ("people: solo", 8)  # its old spelling is somebody's already
    assert after[10] == ("Taken Ltd", None)  # another has the name
    assert after[12] == (None, None) and after[13] == ("", None) and after[14] == ("Quoted", None)
    parked = {k: v for k, v in after.items() if k > 15}
    assert parked == {16: ("President Kim Roe", 7), 17: ("“Quoted”", 14)}
    assert table(merging.undo(done.entities, done.log)) == table(entities)
    rows, log = done.apply_to(mentions, "raw_id", "mention_id")
    assert sorted(r["raw_id"] for r in rows.collect()) == [2, 2, 2, 2, 2, 7, 8, 8, 10]
    assert sorted((r["old"], r["new"]) for r in log.collect()) == [(1, 2), (3, 2)]
    back = rows.join(log, "mention_id", "left").selectExpr("coalesce(old, raw_id) AS raw_id", "mention_id")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in mentions.select("raw_id", "mention_id").collect())


def test_accepted_pairs_chain(spark):
    entities, _, done = run(spark, [(7, 8), (8, 5), (3, 9), (5, 99), (None, 1)])
    after = table(done.entities)
    assert after[7][1] == 8 and after[5][1] == 8 and after[9][1] == 2 and after[1][1] == 2 and after[11][1] == 8
    assert table(merging.undo(done.entities, done.log)) == table(entities)
    again = merging.merge_entities(done.entities, spark.createDataFrame([(2,)], "raw_id long"))
    assert again.log.where("change = 'merge'").count() == 0


def test_nothing(spark):
    empty = spark.createDataFrame([], "id long, name string, entity_type string, canonical_id long")
    done = merging.merge_entities(empty, spark.createDataFrame([], "raw_id long"))
    assert done.entities.count() == 0 and done.log.count() == 0
