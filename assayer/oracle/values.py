"""Fixed values of the SQL answers. They are written out here, apart from the library, so that a slip there is seen."""

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

OFF_TOPIC_PHRASES = (
    "poem", "joke", "story", "recipe", "weather", "news", "sports", "translate", "write me", "write a", "sing",
    "lyrics", "fiction", "stock price", "crypto", "investment advice", "personal advice", "what is the capital",
    "who is the president", "history of", "meaning of life", "tell me about yourself",
)

VALUE_WORDS = (
    "revenue", "amount", "price", "sales", "cost", "value", "total", "payment", "transaction", "spend", "income",
    "earning", "fee", "charge", "invoice", "balance", "profit", "loss",
)

VERDICTS = {
    "A": "Data is highly reliable and AI-ready.",
    "B": "Data is broadly usable; minor issues should be monitored.",
    "C": "Data has notable quality gaps — remediation recommended before AI use.",
    "D": "Data quality is poor; significant remediation required.",
    "F": "Data is not trustworthy for analytics or AI. Do not use without major remediation.",
}

RISKS = {
    "completeness": (
        "KPI dashboards showing incomplete aggregates (under-reported totals).",
        "ML model training on incomplete feature sets → biased predictions.",
        "Segment-level reports missing entire customer groups.",
    ),
    "validity": (
        "Revenue/metric dashboards inflated or deflated by anomalous values.",
        "Statistical models trained on outlier-contaminated data → poor generalization.",
        "Anomaly detection baselines skewed by existing anomalies.",
    ),
    "consistency": (
        "Incorrect joins or lookups when ID/key columns have format mismatches.",
        "Natural language processing or embedding models confused by inconsistent text.",
    ),
    "uniqueness": (
        "Aggregate metrics (SUM, COUNT) over-counted due to duplicates.",
        "Customer/entity counts inflated, distorting segmentation analyses.",
    ),
    "schema": (
        "Pipeline failures when downstream consumers expect a strict schema.",
        "Silent type coercion causing numeric columns to be treated as text.",
    ),
    "freshness": (
        "Decisions based on outdated trends — potential to miss recent business shifts.",
        "Time-series forecasts anchored to stale data may produce wrong projections.",
    ),
}
