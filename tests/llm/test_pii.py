"""Very long runs of digits in addresses."""

from grainspark.llm import pii


def test_a_very_long_run_of_zeros_in_an_address():
    text = "1.2.3." + "0" * 5000
    assert pii.spans(text, pii.anchors()) == [(0, len(text), "ip")]
