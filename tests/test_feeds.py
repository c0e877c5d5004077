import pytest
from pyspark.sql import functions as F

from vigilframe.sources import feeds, files, sinks

CSL = """source,entity_number,type,name,alt_names,citizenships,dates_of_birth,nationalities
Specially Designated Nationals (SDN) - Treasury Department,7001,Vessel,"HARBOUR, LANTERN","LANTERN ""II""; Lamp; ;Lamp",PW,,
Unverified List (UVL),7002,Entity,ELSEWHERE,,,,
Specially Designated Nationals (SDN) - Treasury Department,,Individual,UNNUMBERED,,,,
Specially Designated Nationals (SDN) - Treasury Department,7004,Individual,"Quill, Odette",,NO; FI,3 Feb 1961; 1962,NO
Specially Designated Nationals (SDN) - Treasury Department,7005,Individual,,,,,
"""
OFSI = """Last Updated,17/09/2031

Name 6,Name 1,Name 2,DOB,Nationality,Group Type,Alias Type,Group ID
Fenwick,Teddy,,02/03/1990,Atlantis,Individual,AKA,88
Fenwick,Theodore,Amos,02/03/1991,Lemuria,Individual,Primary name,88
\"\"\"NORTH\"\" PIER, INC\",,,,,Entity,Primary name,89
"""
EU = """<export generationDate="2031-01-02T03:04:05Z"><sanctionEntity logicalId="501"><subjectType code="person"/><nameAlias wholeName=""/><nameAlias firstName="Wanda" lastName="Q" wholeName="Wanda Quist"/><nameAlias firstName="Wendy" lastName="Q" wholeName=""/>
<birthdate birthdate="" year="1958"/><birthdate birthdate="1959-01-01" year="1959"/><citizenship countryIso2Code="SE"/><address countryIso2Code="DK"/><address countryIso2Code="SE"/></sanctionEntity><sanctionEntity logicalId="502"><subjectType code="enterprise"/><nameAlias wholeName="Mirage Freight"/></sanctionEntity></export>"""
UN = """<LIST><A><INDIVIDUAL><DATAID>31</DATAID><FIRST_NAME>Oriel</FIRST_NAME><THIRD_NAME>Van Dusk</THIRD_NAME><NATIONALITY><VALUE>Narnia</VALUE></NATIONALITY><INDIVIDUAL_ALIAS><QUALITY>Low</QUALITY><ALIAS_NAME>The Dusk</ALIAS_NAME></INDIVIDUAL_ALIAS>
<INDIVIDUAL_DATE_OF_BIRTH><YEAR>1947</YEAR></INDIVIDUAL_DATE_OF_BIRTH><INDIVIDUAL_DATE_OF_BIRTH><DATE>1948-11-30</DATE></INDIVIDUAL_DATE_OF_BIRTH></INDIVIDUAL></A><B><ENTITY><DATAID>32</DATAID><FIRST_NAME>Paper Company</FIRST_NAME><ENTITY_ALIAS><ALIAS_NAME>PC</ALIAS_NAME></ENTITY_ALIAS></ENTITY></B></LIST>"""
SDN = """<Sanctions><Sets><Script ID="1">Latin</Script><Script ID="2">Greek</Script></Sets><DistinctParty FixedRef="7001"><Profile><Identity><Alias><DocumentedName><DocumentedNamePart><NamePartValue ScriptID="1">HARBOUR</NamePartValue></DocumentedNamePart></DocumentedName></Alias>
<Alias><DocumentedName><DocumentedNamePart><NamePartValue ScriptID="2">ΛΙΜΑΝΙ</NamePartValue></DocumentedNamePart><DocumentedNamePart><NamePartValue ScriptID="2">ΦΑΝΟΣ</NamePartValue></DocumentedNamePart></DocumentedName><DocumentedName><DocumentedNamePart><NamePartValue ScriptID="77">Q</NamePartValue></DocumentedNamePart></DocumentedName></Alias></Identity></Profile></DistinctParty></Sanctions>"""


def put(tmp_path, name, content):
    (tmp_path / name).write_text(content, encoding="utf-8")
    return f"file://{tmp_path}/{name}"


def by_id(df):
    return {r["entity_id"]: r.asDict(True) for r in df.collect()}


def test_csl(spark, tmp_path):
    got = by_id(feeds.read_csl(spark, put(tmp_path, "csl.csv", CSL), "v1"))
    assert set(got) == {"OFAC_SDN:7001", "OFAC_SDN:7004"}
    assert got["OFAC_SDN:7001"]["primary_name"] == "HARBOUR, LANTERN" and [a["name"] for a in got["OFAC_SDN:7001"]["aliases"]] == ['LANTERN "II"', "Lamp"] and got["OFAC_SDN:7001"]["entity_type"] == "ORGANIZATION"
    assert got["OFAC_SDN:7004"]["countries"] == ["NO", "FI"] and got["OFAC_SDN:7004"]["dob"] == ["3 Feb 1961", "1962"] and got["OFAC_SDN:7004"]["entity_type"] == "PERSON"
    with pytest.raises(ValueError, match="alt_names"):
        feeds.read_csl(spark, put(tmp_path, "bad.csv", "source,entity_number,type,name\n"), "v1")


def test_ofsi_folds_groups(spark, tmp_path):
    got = by_id(feeds.read_ofsi(spark, put(tmp_path, "uk.csv", OFSI), "v1"))
    assert got["UK_OFSI:88"]["primary_name"] == "Theodore Amos Fenwick" and [a["name"] for a in got["UK_OFSI:88"]["aliases"]] == ["Teddy Fenwick"]
    assert got["UK_OFSI:88"]["dob"] == ["02/03/1991"] and got["UK_OFSI:88"]["countries"] == ["Lemuria"]
    assert got["UK_OFSI:89"]["primary_name"] == '"NORTH" PIER, INC' and got["UK_OFSI:89"]["entity_type"] == "ORGANIZATION"
    assert feeds.read_ofsi(spark, put(tmp_path, "none.csv", "a,b\n"), "v1").count() == 0


def test_eu_and_un(spark, tmp_path):
    eu = by_id(feeds.read_eu(spark, put(tmp_path, "eu.xml", EU), "v1"))
    assert eu["EU:501"]["primary_name"] == "Wanda Quist" and [a["name"] for a in eu["EU:501"]["aliases"]] == ["Wendy Q"]
    assert eu["EU:501"]["countries"] == ["DK", "SE"] and eu["EU:501"]["dob"] == ["1958"] and eu["EU:502"]["entity_type"] == "ORGANIZATION" and eu["EU:502"]["dob"] == []
    un = by_id(feeds.read_un(spark, put(tmp_path, "un.xml", UN), "v1"))
    assert un["UN:31"]["primary_name"] == "Oriel Van Dusk" and un["UN:31"]["dob"] == ["1948-11-30"] and un["UN:31"]["countries"] == ["Narnia"]
    assert un["UN:32"]["entity_type"] == "ORGANIZATION" and [a["name"] for a in un["UN:32"]["aliases"]] == ["PC"]


def test_script_aliases_enrich(spark, tmp_path):
    path = put(tmp_path, "sdn.xml", SDN)
    extra = feeds.read_script_aliases(spark, path)
    assert {tuple(r) for r in extra.collect()} == {("7001", "ΛΙΜΑΝΙ ΦΑΝΟΣ", "Greek"), ("7001", "Q", "Unknown")}
    lines = feeds.read_csl(spark, put(tmp_path, "csl.csv", CSL), "v1")
    more = extra.select("number", "name").union(spark.createDataFrame([("7001", "LAMP"), ("7001", "harbour, lantern")], "number string, name string"))
    got = by_id(feeds.apply_alias_enrichment(lines, more))
    assert [a["name"] for a in got["OFAC_SDN:7001"]["aliases"]] == ['LANTERN "II"', "Lamp", "Q", "ΛΙΜΑΝΙ ΦΑΝΟΣ"] and got["OFAC_SDN:7004"]["aliases"] == []
    with pytest.raises(ValueError, match="more than 10"):
        feeds.check_feed_size(spark, path, 10)


def test_publish_and_read_back(spark, tmp_path):
    lines = feeds.read_csl(spark, put(tmp_path, "csl.csv", CSL), "v1")
    wire = files.to_wire(lines)
    row = by_id(wire)["OFAC_SDN:7004"]
    assert row["name_canonical"] == "quill odette" and row["dob"] == "1961-02-03" and row["countries"] == ["FI", "NO"]
    back = by_id(files.from_wire(wire))["OFAC_SDN:7001"]
    assert back["primary_name"] == "Harbour Lantern" and back["entity_type"] == "PERSON" and [a["name_canonical"] for a in back["aliases"]] == ["lantern ii", "lamp"]
    catalog = sinks.write_bundle(wire, f"file://{tmp_path}/bundle", "2026-01-01T00:00:00Z")
    assert [(r["id"], r["entitiesCount"]) for r in catalog.collect()] == [("OFAC_SDN", 2)]
    read = files.read_entities(spark, f"file://{tmp_path}/bundle/entities")
    assert read.count() == 2
    bad = put(tmp_path, "bad.jsonl", '{"entity_id":"x","name_canonical":"y","source_list":"z","risk_category":"RUMOUR"}\n')
    with pytest.raises(Exception, match="risk category"):
        files.read_entities(spark, bad).collect()


def test_vectors_file(spark, tmp_path):
    import numpy as np

    (tmp_path / "v.f32").write_bytes(np.arange(6, dtype="<f4").tobytes())
    got = [(r["position"], list(r["vector"])) for r in files.read_vectors(spark, f"file://{tmp_path}/v.f32", 3).collect()]
    assert got == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    with pytest.raises(Exception, match="whole rows"):
        files.read_vectors(spark, f"file://{tmp_path}/v.f32", 4).collect()


def test_text_table(spark):
    line = sinks.text_table(spark.createDataFrame([("a", None)], "x string, y int"), {"x": 3, "y": 2}).first()[0]
    assert line == "a    - "
    assert spark.range(1).select(F.lit(1)).count() == 1
