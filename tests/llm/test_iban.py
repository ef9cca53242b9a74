"""IBANs whatever follows them."""

from sparktn.llm import pii

GB, DE = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"


def with_check(country, rest):
    value = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{country}{98 - value % 97:02d}{rest}"


def test_what_follows(spark):
    odd = with_check("QQ", "ABC123456789012345")
    cases = [
        (f"{GB} Please pay", [GB]), (f"{DE} Tel 5", [DE]), (f"{GB} BIC ABCD", [GB]), (f"to {GB} 12 or {DE} 7 X", [GB, DE]), (f"{GB} {DE} {GB}", [GB, DE, GB]), (f"AB12 {GB}", [GB]), (f"{odd} Next", [odd]), (f"{odd} A B", [odd]),
        (f"{DE}Tel", []), (f"{DE}7", []), (f"x{DE}", []), (GB.replace("82", "83") + " Please", []), (f"{GB}.", [GB]), (DE, [DE]), (f"\U0001f600 {GB} \u00e9", [GB]), ("", []), (None, []),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.found(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")).collect()}
    for i, (t, want) in enumerate(cases):
        assert [t[s["start"] : s["stop"]] for s in got[i] if s["kind"] == "iban"] == want, t
