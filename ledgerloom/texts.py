"""Codes, labels and sentences of the results.

Codes, labels, categories and the reasons of both registers are fixed values: published results, labelled
truth and grouping by them need these very texts. The other sentences are this library's own.
"""

# Settlement types
BASE_TYPES = ("settlement", "split_payment")
ADJUSTMENT_TYPES = ("settlement_adjustment", "cashback_adjustment")
REVERSAL_TYPES = ("refund", "partial_refund", "chargeback")
MATCHABLE_TYPES = ("settlement", "split_payment", "refund", "partial_refund", "chargeback", "cashback_adjustment")

LEG_LABELS = {
    "settlement": "Main settlement",
    "split_payment": "Split payment leg",
    "duplicate_settlement": "Duplicate settlement webhook",
    "refund": "Full refund",
    "partial_refund": "Partial refund",
    "chargeback": "Chargeback",
    "settlement_adjustment": "Settlement adjustment",
    "cashback_adjustment": "Cashback credit",
}

PROCESSOR_TYPES = {"payment": "settlement", "refund": "refund", "adjustment": "settlement_adjustment"}

# Match types
EXACT, FX, FUZZY, SPLIT, LIFECYCLE, PROPOSED = (
    "exact_id", "fx_conversion", "fuzzy_amount_date", "split_bank_entries",
    "lifecycle_adjustment", "llm_review_candidate",
)

MATCH_DISPLAY = {
    "exact_id": "Exact ID match",
    "fuzzy_amount_date": "Fuzzy amount / date",
    "split_bank_entries": "Split bank entries",
    "lifecycle_adjustment": "Lifecycle adjustment",
    "fx_conversion": "FX conversion",
    "llm_review_candidate": "AI-assisted review",
}

# Decisions
AUTO, REVIEW, EXCEPTION = "AUTO_ACCEPTED", "NEEDS_REVIEW", "EXCEPTION"
ADVICE = "AI_RECOMMENDATION_REQUIRES_HUMAN_REVIEW"

# Reasons of the detailed exception register
REASON_BY_TYPE = {
    "duplicate_settlement": "Duplicate processor webhook has no independent bank credit. Left unresolved rather than matched to the original payout.",
    "settlement_adjustment": "Settlement adjustment has no balancing base-settlement and bank-credit evidence. Manual review required.",
    "chargeback": "Chargeback has no evidenced matching bank debit. Manual review required; it was not assumed to be a refund.",
    "cashback_adjustment": "Additional credit has no evidenced bank movement. Manual review required.",
}
REASON_AMBIGUOUS = "Ambiguous candidate: multiple bank movements satisfy the amount/date constraints without identifying evidence. Left as an exception."
REASON_NO_DEBIT = "No bank debit found within 15 days - possible delayed or failed refund debit."
REASON_NO_CREDIT = "No bank credit found within 15 days - possible delayed or failed settlement credit."
REASON_OUTSIDE = "Unresolved - closest bank candidates fall outside amount/date tolerance. Needs manual review."
LEDGER_DUPLICATE_FORMAT = "Duplicate ledger entry detected: %d internal records but %d processor payment leg(s). The extra %d ledger record(s) were not treated as missing money."
LEDGER_REPEAT_FORMAT = "Duplicate ledger records: %d entries share this order ID."

# Reasons of the coarse exception register
COARSE_BY_TYPE = {
    "chargeback": "Chargeback lacks an evidenced matching bank debit; not assumed to be a refund.",
    "settlement_adjustment": "Adjustment lacks balancing processor and bank evidence.",
}
COARSE_OTHER = "No unique, evidence-backed candidate within configured amount/date tolerances."

# Candidate audit, replay and review texts
REJECTED_BY_LEG = "Another line fits this leg better."
REJECTED_BY_LINE = "Another leg fits this line better."
REPLAY_REASON = "Delivered again: same fingerprint as a row kept."
QUEUE_REASON = "Evidence leaves a choice: rank the listed lines only, a person decides."
GATE_MALFORMED = "The reply is not a JSON object."
GATE_UNKNOWN_ID = "The reply names a line that is not among the listed ones."
GATE_NO_REASON = "The reply gives no reason."

# Match notes
NOTE_EXACT = "The narration names the order; amount and day fit."
NOTE_SPLIT = "Two lines left over add up to the leg."

# Exception categories, first matching word wins
CATEGORY_RULES = (
    (("duplicate",), "Duplicate"),
    (("ambiguous",), "Ambiguous candidate"),
    (("amount",), "Amount discrepancy"),
    (("delay", "timing"), "Timing mismatch"),
    (("bank",), "Missing bank movement"),
)
CATEGORY_OTHER = "Insufficient evidence"

# Evaluation case types
CASE_DUPLICATE, CASE_AMBIGUOUS, CASE_MISSING = "Duplicate", "Ambiguous candidate", "Missing bank transaction"
CASE_SPLIT_REFUND, CASE_PARTIAL_REFUND, CASE_LIFECYCLE = "Split refund", "Partial refund", "Lifecycle adjustment"
CASE_DELAYED, CASE_DISCREPANCY, CASE_NORMAL = "Delayed settlement", "Small amount discrepancy", "Normal match"

# States of the exception register.
OPEN, RESOLVED, SUPERSEDED = "OPEN", "RESOLVED", "SUPERSEDED"
