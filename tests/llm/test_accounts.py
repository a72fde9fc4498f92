"""Bank account numbers that other words follow."""

import pytest

from gaugework.llm import pii


@pytest.mark.parametrize(
    "before, account, after",
    [
        ("IBAN ", "GB82 WEST 1234 5698 7654 32", " BIC DEUTDEFF"), ("", "GB82WEST12345698765432", " EUR 100"),
        ("", "DE89370400440532013000", " 2024"), ("to ", "DE89370400440532013000", " GB82WEST12345698765432"),
        ("", "DE89 3704 0044 0532 0130 00", ".")
    ]
)
def test_accounts(before, account, after):
    at = len(before)
    assert pii.accounts(before + account + after)[0] == ("iban", at, at + len(account))
    if "WEST" in after:
        assert len(pii.accounts(before + account + after)) == 2


def test_no_account():
    assert pii.accounts("GB82WEST12345698765433 EUR 100") == [] == pii.accounts("xGB82WEST12345698765432 and GB82WEST12345698765432x")
