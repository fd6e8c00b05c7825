"""Ownership documents and index files against hand-made cases."""

from __future__ import annotations

import datetime as dt
import hashlib
from decimal import Decimal

from tidemark.sources import ownership, payloads


def transaction(code="P", acquired="A", title="Common Stock", date="2020-04-03", shares="10", price="1922.6925", note="F2", form="4"):
    mark = f'<footnoteId id="{note}"/>' if note else ""
    return (
        f"<nonDerivativeTransaction><securityTitle><value>{title}</value></securityTitle><transactionDate><value>{date}</value></transactionDate><transactionCoding><transactionFormType>{form}</transactionFormType><transactionCode>{code}</transactionCode></transactionCoding>"
        f"<transactionAmounts><transactionShares><value>{shares}</value></transactionShares><transactionPricePerShare><value>{price}</value>{mark}</transactionPricePerShare><transactionAcquiredDisposedCode><value>{acquired}</value></transactionAcquiredDisposedCode></transactionAmounts>"
        "<postTransactionAmounts><sharesOwnedFollowingTransaction><value>100.5</value></sharesOwnedFollowingTransaction></postTransactionAmounts><ownershipNature><directOrIndirectOwnership><value>D</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction>"
    )


def document(lines="", owners=(("0001769274", "A. Owner"),), kind="4", notes="", derivative="", remarks="", extra=""):
    who = "".join(f"<reportingOwner><reportingOwnerId><rptOwnerCik>{c}</rptOwnerCik><rptOwnerName>{n}</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>false</isOfficer></reportingOwnerRelationship></reportingOwner>" for c, n in owners)
    return (
        f'<?xml version="1.0"?>\n<ownershipDocument><documentType>{kind}</documentType><periodOfReport>2020-04-03</periodOfReport>{extra}<issuer><issuerCik>0001018724</issuerCik><issuerName>Some Co</issuerName><issuerTradingSymbol>SOME</issuerTradingSymbol></issuer>'
        f"{who}<nonDerivativeTable>{lines}</nonDerivativeTable><derivativeTable>{derivative}</derivativeTable><footnotes>{notes}</footnotes><remarks>{remarks}</remarks></ownershipDocument>\n<!-- tail -->"
    )


def test_ownership_tables(spark):
    two = (("1", "One"), ("2", "Two"), ("1", "One again"))
    cases = {
        "strict": document(transaction(), notes='<footnote id="F2">Bought  at\n market</footnote>'),
        "owners": document(transaction() + transaction(code="S", acquired="D"), two),
        "amended": document(transaction(), kind="4/A", derivative="<derivativeTransaction><transactionCoding><transactionCode>p</transactionCode></transactionCoding></derivativeTransaction>"),
        "private": document(transaction(), notes='<footnote id="F2">a PRIVATE placement</footnote><footnote id="F2">other</footnote><footnote>no id</footnote>', remarks="Under a subscription agreement"),
        "late": document(transaction(date="2020-03-01-05:00")),
        "prices": document(transaction(price="") + transaction(price="0") + transaction(shares="many")),
        "titles": document(transaction(title="Class A Common-Stock") + transaction(title="Restricted Stock Unit") + transaction(title="")),
        "not_subject": document(transaction(), extra="<notSubjectToSection16>TRUE</notSubjectToSection16>"),
        "empty": document(owners=()), "broken": "<ownershipDocument><a>", "none": None,
    }
    df = spark.createDataFrame([(k, dt.date(2020, 4, 6), "1018724" if k != "late" else "7", v) for k, v in cases.items()], "id string, filed date, cik string, xml string")
    docs = ownership.parsed(df, ["id", "filed", "cik"], "xml")
    s = {r.id: r for r in ownership.submissions(docs, ["id", "cik"], "cik").collect()}
    assert {"broken", "none"}.isdisjoint(s) or all(s[k].document_type is None for k in ("broken", "none") if k in s)
    assert s["owners"].owner_ciks == ["1", "2"] and s["owners"].has_sales and s["owners"].n_transactions == 2
    assert s["amended"].flags == ["amendment", "derivative_p_present"] and s["amended"].n_derivative == 1 and s["late"].flags == ["archive_cik_differs_from_issuer_cik"] and s["not_subject"].flags == ["not_subject_to_section16"]
    assert s["strict"].period_of_report == dt.date(2020, 4, 3) and s["strict"].ticker == "SOME" and s["empty"].n_transactions == 0 and s["private"].n_footnotes == 1
    o = [(r.owner_no, r.owner_cik, r.owner_name, r.is_director, r.is_officer) for r in ownership.owners(docs, ["id"]).where("id = 'owners'").orderBy("owner_no").collect()]
    assert o == [(0, "1", "One", True, False), (1, "2", "Two", True, False)]
    notes = {(r.id, r.footnote_id): r.text for r in ownership.footnotes(docs, ["id"]).collect()}
    assert notes == {("strict", "F2"): "Bought at market", ("private", "F2"): "other"}
    rows: dict = {}
    for r in ownership.transactions(docs, ["id", "filed", "cik"], "filed", "cik").orderBy("line").collect():
        rows.setdefault(r.id, []).append(r)
    one = rows["strict"][0]
    assert one.signal and one.flags == [] and one.footnote_ids == ["F2"] and one.footnote_text == "Bought at market" and one.price == Decimal("1922.6925") and one.value == Decimal("19226.925") and one.shares_after == Decimal("100.5") and one.direct_or_indirect == "D"
    assert [r.flags for r in rows["owners"]] == [["mixed_p_and_s"]] * 2 and not any(r.signal for r in rows["owners"])
    assert rows["private"][0].flags == ["private_or_unit_purchase_flag"] and rows["private"][0].footnote_text == "other"
    assert "late_report" in rows["late"][0].flags and rows["late"][0].traded_on == dt.date(2020, 3, 1)
    assert [r.flags for r in rows["prices"]] == [["missing_price"], ["zero_price"], []] and [r.signal for r in rows["prices"]] == [False] * 3
    assert [r.flags for r in rows["titles"]] == [[], ["non_common_security_title"], ["non_common_security_title"]] and rows["titles"][0].signal
    assert not rows["amended"][0].signal and not rows["not_subject"][0].signal and "empty" not in rows


def test_index_files(spark, tmp_path):
    fixed = "4           Some Company  Inc                                  1018724     2020-04-06  edgar/data/1018724/0001127602-20-013168.txt"
    lines = ["Form Type   Company Name", "-" * 30, fixed, "10-K        Other                                              7           2020-04-06  edgar/data/7/0000000007-20-000001.txt", "4/A         Odd", ""]
    piped = ["CIK|Company Name|Form Type|Date Filed|Filename", "1018724|Some|4|2020-04-06|edgar/data/1018724/000112760220013168/0001127602-20-013169.txt", "5|No date|4|soon|edgar/data/5/x.txt", "too|few", "6|Undashed|4/A|2020-05-01|edgar/data/6/accession.txt"]
    (tmp_path / "a.idx").write_text("\n".join(lines))
    (tmp_path / "b.idx").write_text("\n".join(piped))
    rows = {r.accession: r for r in payloads.index_manifest(payloads.index_files(spark, str(tmp_path)), "line", ("4", "4/A")).collect()}
    assert set(rows) == {"0001127602-20-013168", "0001127602-20-013169", "accession"}
    assert rows["0001127602-20-013168"].company == "Some Company  Inc" and rows["0001127602-20-013168"].cik == "1018724" and rows["0001127602-20-013168"].accession_no_dashes == "000112760220013168"
    sha = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.idx", "b.idx")}
    assert rows["0001127602-20-013168"].file_hash == sha["a.idx"] and rows["accession"].file_hash == sha["b.idx"] and rows["accession"].form == "4/A"
