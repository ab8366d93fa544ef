import pytest

from weftgraph.sources import lead_files as lf
from weftgraph.sources.tables import LeadFileError


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_rows_of_files_with_other_headers(spark, tmp_path):
    one = write(tmp_path / "a.csv", '﻿WT_MC_ID , Leads_Most_Recent_Tag,main_conversion_page\n" ,TAG_1","1,200",HTTPS://X.test/A?q\n,3,\n"TAG\n2",,x.test/b\n')
    two = write(tmp_path / "b.csv", "paid_click_leads,leads_most_recent_tag,wt_mc_id,extra\n2,4,TAG_1,z\n,5.5,,z\n")
    rows = lf.checked_rows(spark, [one, two])
    found = sorted((r["file"][-5:], r["row"], r["lead_tag"], r["leads"], r["paid_leads"], r["page"]) for r in rows.collect())
    assert found == [("a.csv", 2, "TAG_1", 1200.0, 0.0, "https://x.test/a"), ("a.csv", 3, None, 3.0, 0.0, None), ("a.csv", 4, "TAG\n2", 0.0, 0.0, "https://x.test/b"), ("b.csv", 2, "TAG_1", 4.0, 2.0, None), ("b.csv", 3, None, 5.5, 0.0, None)]
    assert tuple(lf.tag_totals(rows).first()) == (1204.0, 8.5)
    assert sorted(map(tuple, lf.tag_pages(rows).collect())) == [("TAG\n2", "https://x.test/b"), ("TAG_1", "https://x.test/a")]


def test_all_faults_of_all_files_are_told_with_their_rows(spark, tmp_path):
    write(tmp_path / "a.csv", 'wt_mc_id,leads_most_recent_tag,note\nT,1,"two\nlines"\nT,many,x\nU,1,someone@mail.test\n')
    write(tmp_path / "b.csv", "wt_mc_id,paid_click_leads,visitor_id\nT,1,1\n")
    write(tmp_path / "c.csv", "wt_mc_id,leads_most_recent_tag,paid_click_leads\nT,1,n/a\n")
    with pytest.raises(LeadFileError) as error:
        lf.checked_rows(spark, [f"file://{tmp_path}"])
    assert str(error.value).split("\n") == [
        "a.csv row 3: the value of leads_most_recent_tag is no number",
        "a.csv row 4: the value of note identifies persons",
        "b.csv row 1: column leads_most_recent_tag is missing",
        "b.csv row 1: column visitor_id identifies persons",
        "c.csv row 2: the value of paid_click_leads is no number",
    ]
    assert "mail.test" not in str(error.value)


def test_many_faults_are_counted(spark, tmp_path):
    path = write(tmp_path / "a.csv", "wt_mc_id,leads_most_recent_tag\n" + "T,x\n" * 50)
    with pytest.raises(LeadFileError, match="row 21.*\nand 30 more"):
        lf.checked_rows(spark, [path])
