import gzip
import json
import zipfile

import pytest

from veedor.operators import releases as rel
from veedor.sources import readers, sinks

RELEASE = {
    "ocid": "ocds-x-1", "date": "2026-02-01T00:00:00Z", "buyer": {"id": "b", "name": "HOSPITAL LIMA"},
    "tender": {"id": "T1", "procurementMethod": "open", "title": "t", "value": {"amount": 10.0}, "documents": [{"id": "1", "title": "Bases Integradas", "url": "u", "format": "pdf"}]},
    "awards": [{"id": "A", "date": "2026-02-03", "value": {"amount": 950.5}, "suppliers": [{"id": "PE-RUC-20987654321", "name": "S"}]}],
    "parties": [{"id": "b", "name": "HOSPITAL LIMA", "roles": ["buyer"], "identifier": {"id": "1", "scheme": "X"}, "additionalIdentifiers": [{"id": "20123456789", "scheme": "PE-RUC"}], "address": {"department": "lima"}}],
}


def test_releases_lines_gz_and_package(spark, tmp_path):
    bare = {"ocid": "ocds-x-2", "tender": {"value": {"amount": 5.0}}}
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps(RELEASE) + "\nnot json\n" + json.dumps(bare))
    (tmp_path / "b.json").write_text(json.dumps({"releases": [RELEASE, bare]}))
    for path, multi in (("a.jsonl.gz", False), ("b.json", True)):
        rows = {r.ocid: r for r in rel.flatten(readers.releases(spark, str(tmp_path / path), multi)).collect()}
        r = rows["ocds-x-1"]
        assert (r.record_type, r.entity_ruc, r.supplier_ruc, r.monto, r.period_year, r.region, r.external_id) == ("contract", "20123456789", "20987654321", 950.5, 2026, "LIMA", "ocds-x-1:A:20987654321")
        assert (rows["ocds-x-2"].record_type, rows["ocds-x-2"].supplier_ruc, rows["ocds-x-2"].monto) == ("procedure", None, 5.0)
    p, d, a = rel.split(readers.releases(spark, str(tmp_path / "a.jsonl.gz")))
    assert p.where("ocid = 'ocds-x-1'").first().sector == "salud" and d.first().document_id == "ocds-x-1-0001" and a.first().amount == 950.5


def test_register_text_and_zip(spark, tmp_path):
    line = "20987654321|PROVEEDOR ÑANDU SAC|ACTIVO|HABIDO|150101|AV.|LIMA||||||||\n20111111111|X\n"
    (tmp_path / "r.txt").write_bytes(line.encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("r.txt", line.encode("latin-1"))
    for name in ("r.txt", "r.zip"):
        rows = {r.ruc: r for r in readers.register(spark, str(tmp_path / name)).collect()}
        assert rows["20987654321"].razon_social == "PROVEEDOR ÑANDU SAC" and rows["20111111111"].kilometro == "" and len(rows) == 2


def test_delimited_and_required(spark, tmp_path):
    for sep in ",;|\t":
        (tmp_path / "d.csv").write_text(sep.join(["a", "b", "c"]) + "\n" + sep.join("123") + "\n")
        assert readers.delimited(spark, str(tmp_path / "d.csv"), ("a", "c")).first().b == "2"
    with pytest.raises(ValueError, match="missing"):
        readers.delimited(spark, str(tmp_path / "d.csv"), ("zz",))


def test_catalogue_dossiers_procedures(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"result": {"results": [{"name": "d", "title": "t", "resources": [{"name": "r", "format": "csv", "url": "u"}, {"name": "s"}]}]}}))
    assert [r.resource for r in readers.catalogue(spark, str(tmp_path / "c.json")).orderBy("resource").collect()] == ["r", "s"]
    folder = tmp_path / "dossiers" / "ocds-1"
    folder.mkdir(parents=True)
    (folder / "dossier.json").write_text(json.dumps({"entity_name": "e", "total_score": 20, "risk_level": "BAJO"}))
    (folder / "flags.json").write_text(json.dumps([{"flag_code": "F", "page_number": 3}, {"flag_code": "G", "page_number": 4}]))
    (folder / "metadata.json").write_text(json.dumps({"uuid": "u1", "codigo": "AS-1"}))
    d, f = readers.dossiers(spark, str(tmp_path / "dossiers"))
    assert d.first().ocid == "ocds-1" and sorted(r.flag_id for r in f.collect()) == ["ocds-1_F_p3", "ocds-1_G_p4"]
    assert readers.procedures(spark, str(tmp_path / "dossiers")).first().codigo == "AS-1"


def test_spreadsheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>2.5</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    assert [list(r.cells) for r in readers.spreadsheet(spark, str(tmp_path / "x.xlsx")).orderBy("row").collect()] == [["head", "2.5"], ["in"]]


def test_sources_jsonl_and_sinks(spark, tmp_path):
    rows = [("OCDS", "api", "P0", "active"), ("X", "csv", "P1", "active"), ("Y", "csv", "P0", "off")]
    assert [r.source_code for r in readers.sources(spark, rows, "active", "P0").collect()] == ["OCDS"]
    df = spark.createDataFrame([("a", 1, "k"), ("b", 2, "k")], "id string, v int, g string")
    for _ in range(2):
        t = sinks.merge_table(df, str(tmp_path / "t"), ["id"], "v")
    t = sinks.merge_table(spark.createDataFrame([("a", 5, "k"), ("c", 1, "g")], df.schema), str(tmp_path / "t"), ["id"], "v")
    assert {(r.id, r.v) for r in t.collect()} == {("a", 5), ("b", 2), ("c", 1)}
    sinks.json_artifacts(df, str(tmp_path / "j"), "g")
    assert readers.jsonl(spark, str(tmp_path / "j" / "g=k"), "id string, v int", 1).count() == 1
    sinks.csv_tables({"one": df}, str(tmp_path / "csv"))
    assert readers.delimited(spark, str(tmp_path / "csv" / "one")).count() == 2
