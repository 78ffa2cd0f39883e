from pyspark.sql import functions as F

from webrel.operators import hits as H


def rows(spark, *docs):
    df = spark.createDataFrame([(i, d, "kept") for i, d in enumerate(docs)], "page_id int, js string, hit_no string")
    return df.select("page_id", F.col("hit_no").alias("other"), F.try_parse_json("js").alias("payload"))


def test_fall_backs_and_malformed_groups(spark):
    got = H.nested_search_hits(rows(
        spark,
        '{"data": {"elements": [{"elements": [{"entityResult": {"title": {"text": " Ann "}, "url": "/in/a"}, "trackingUrn": "u:member:7"}, 3, null,'
        ' {"member": {"firstName": "Bo", "subtitle": {"text": "s"}, "navigationUrl": "http://x/b", "trackingUrn": "u:member:8,"}}]}]}}',
        '{"data": {"elements": []}, "elements": [5, "x", null, [1], {"elements": "none"}, {"elements": null}, {"firstName": "Cy"},'
        ' {"entityResult": {}, "member": null, "entityLockupView": {"primaryText": {"text": "Di"}}}]}',
        '{"elements": [{"entityResult": "text"}, {"firstName": "LinkedIn MEMBER"}, {"title": {"text": ""}}, {"title": null}]}',
        '{"elements": [{"firstName": "Ed", "insightViewModel": {"insightComponents": [{}, {"lockupViewModel": null},'
        ' {"lockupViewModel": {"title": {"text": ""}}}, {"lockupViewModel": {"title": {"text": "told"}}}, {"lockupViewModel": {"title": {"text": "b"}}}]}}]}',
        '{"elements": {"a": {"firstName": "No"}}}', "[]", "not json", "7", None)).orderBy("page_id", "group_no", "hit_no").collect()
    assert [(r.page_id, r.group_no, r.hit_no, r.name, r.headline, r.profile_url, r.profile_id, r.snippet, r.other) for r in got] == [
        (0, 0, 0, "Ann", "", "https://www.linkedin.com/in/a", "7", "", "kept"), (0, 0, 3, "Bo", "s", "http://x/b", "8", "", "kept"),
        (1, 6, 0, "Cy", "", "", "", "", "kept"), (1, 7, 0, "Di", "", "", "", "", "kept"), (3, 0, 0, "Ed", "", "", "", "told", "kept")]


def test_empty_table(spark):
    assert H.nested_search_hits(rows(spark, "{}").limit(0)).collect() == []
    assert H.position_rows(rows(spark, "{}").limit(0)).collect() == []


def test_profile_fields(spark):
    out = rows(spark, '{"firstName": "A", "lastName": "", "connectionsCount": 0, "geoLocationName": "G", "industryName": null}', "{}", None)
    got = [r.f for r in out.orderBy("page_id").select(H.profile_fields(F.col("payload")).alias("f")).collect()]
    assert got == [{"first_name": "A", "name": "A", "connections": "0", "location": "G"}, {}, {}]


def test_positions_in_order(spark):
    got = H.position_rows(rows(
        spark, '{"elements": [{"title": {"text": "T"}, "description": {"text": "' + "é" * 400 + '"}}, {"title": {}}, 4,'
        ' {"entityLockupView": {"title": {"text": "U"}, "subtitle": {"text": "c"}}}], "data": {"elements": [{"title": {"text": "no"}}]}}',
        '{"data": {"elements": [{"title": {"text": "V"}}]}}', '{"elements": 3}')).orderBy("page_id", "position_no").collect()
    assert [(r.page_id, r.position_no, r.title, r.company, len(r.description)) for r in got] == [
        (0, 0, "T", "", 300), (0, 3, "U", "c", 0), (1, 0, "V", "", 0)]
