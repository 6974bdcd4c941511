"""Declared schemas of the stored tables (nothing is inferred)."""
from pyspark.sql import types as T


COMPANIES = ("company_id BIGINT, cik STRING, ticker STRING, name STRING, sic_code STRING, sic_description STRING, "
               "sector STRING, exchange STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP")
FILINGS = ("filing_id BIGINT, company_id BIGINT, accession_number STRING, form_type STRING, filed_at DATE, "
             "period_of_report DATE, fiscal_year INT, fiscal_quarter INT, raw_key STRING, raw_size_bytes BIGINT, "
             "is_extracted BOOLEAN, is_xbrl_parsed BOOLEAN, is_embedded BOOLEAN, is_form4_parsed BOOLEAN, "
             "is_signal_scored BOOLEAN, is_anomaly_scored BOOLEAN, is_text_signal_scored BOOLEAN, "
             "is_numeric_signal_scored BOOLEAN, is_insider_signal_scored BOOLEAN, is_composite_signal_scored BOOLEAN, "
             "processing_status STRING, last_error_message STRING, created_at TIMESTAMP")
FILING_SECTIONS = ("section_id BIGINT, filing_id BIGINT, company_id BIGINT, section STRING, sequence_idx SMALLINT, "
                     "text STRING, s3_key STRING, extractor_version STRING")
XBRL_FACTS = ("fact_id BIGINT, company_id BIGINT, filing_id BIGINT, taxonomy STRING, concept STRING, label STRING, "
                "value DECIMAL(38,10), unit STRING, decimals STRING, period_type STRING, period_start DATE, "
                "period_end DATE, fiscal_year INT, fiscal_quarter INT, form_type STRING, created_at TIMESTAMP")
GUIDANCE_STATEMENTS = ("filing_id BIGINT, company_id BIGINT, statement STRING, metric STRING, created_at TIMESTAMP")
EMBEDDINGS = ("filing_section_id BIGINT, company_id BIGINT, filing_id BIGINT, chunk_idx INT, text STRING, "
                "embedding ARRAY<FLOAT>, provider STRING, embedding_model STRING, reconstruction_error DOUBLE, "
                "anomaly_score DOUBLE")
INSIDER_TRANSACTIONS = (
    "transaction_id BIGINT, filing_id BIGINT, company_id BIGINT, transaction_uid STRING, accession_number STRING, cik STRING, "
    "ticker STRING, issuer_name STRING, security_title STRING, insider_name STRING, insider_cik STRING, "
    "is_director BOOLEAN, is_officer BOOLEAN, is_ten_percent_owner BOOLEAN, is_other BOOLEAN, officer_title STRING, "
    "transaction_date DATE, transaction_code STRING, transaction_type_normalized STRING, shares DECIMAL(38,10), "
    "price_per_share DECIMAL(38,10), transaction_value DECIMAL(38,10), shares_owned_after DECIMAL(38,10), "
    "ownership_nature STRING, acquired_disposed_code STRING, is_derivative BOOLEAN, form_type STRING, filed_at DATE, "
    "source_url STRING, raw_detail STRING")
SIGNAL_SCORES = ("filing_id BIGINT, company_id BIGINT, signal_name STRING, signal_value DOUBLE, detail STRING, "
                   "model_version STRING, computed_at TIMESTAMP")
PIPELINE_EVENTS = ("filing_id BIGINT, company_id BIGINT, event_type STRING, layer STRING, duration_ms INT, detail STRING, "
                     "occurred_at TIMESTAMP")
NCI_SCORES = ("company_id BIGINT, filing_id BIGINT, event_type STRING, fiscal_year INT, fiscal_quarter INT, "
                "nci_global DOUBLE, nci_lower DOUBLE, nci_upper DOUBLE, convergence_tier STRING, layers_elevated INT, "
                "confidence STRING, coverage_ratio DOUBLE, signal_text DOUBLE, signal_mda DOUBLE, "
                "signal_pessimism DOUBLE, signal_fundamental DOUBLE, signal_balance DOUBLE, signal_growth DOUBLE, "
                "signal_earnings DOUBLE, signal_anomaly DOUBLE, signal_insider DOUBLE, signal_market DOUBLE, "
                "signal_sentiment DOUBLE, text_source_filing BIGINT, xbrl_source_filing BIGINT, text_staleness_days INT, "
                "data_fresh BOOLEAN, staleness_reason STRING, computed_at TIMESTAMP")
NEWS_ITEMS = ("company_id BIGINT, ticker STRING, source_name STRING, publisher STRING, headline STRING, summary STRING, "
                "url STRING, published_at TIMESTAMP, retrieved_at TIMESTAMP, dedupe_hash STRING, "
                "sentiment_label STRING, raw_json STRING")
MARKET_PRICES = ("company_id BIGINT, ticker STRING, trading_date DATE, open DECIMAL(18,6), high DECIMAL(18,6), "
                   "low DECIMAL(18,6), close DECIMAL(18,6), adjusted_close DECIMAL(18,6), volume BIGINT, "
                   "provider STRING, retrieved_at TIMESTAMP")
MACRO_OBSERVATIONS = ("series_id STRING, observation_date DATE, value DECIMAL(18,6), provider STRING, "
                        "retrieved_at TIMESTAMP, frequency STRING, units STRING, title STRING")
QUARANTINE = ("step STRING, subject STRING, filing_id BIGINT, company_id BIGINT, input_hash STRING, reason STRING, attempts INT, "
              "first_at TIMESTAMP, last_at TIMESTAMP")

_DDL = {
    "companies": COMPANIES, "filings": FILINGS, "filing_sections": FILING_SECTIONS, "xbrl_facts": XBRL_FACTS,
    "guidance_statements": GUIDANCE_STATEMENTS, "embeddings": EMBEDDINGS,
    "insider_transactions": INSIDER_TRANSACTIONS, "signal_scores": SIGNAL_SCORES, "pipeline_events": PIPELINE_EVENTS,
    "nci_scores": NCI_SCORES, "news_items": NEWS_ITEMS, "market_prices": MARKET_PRICES,
    "macro_observations": MACRO_OBSERVATIONS, "quarantine": QUARANTINE,
}


class _Tables(dict):
    """Parsed on first use: reading a DDL string needs a running session."""

    def __missing__(self, name):
        self[name] = T.StructType.fromDDL(_DDL[name])
        return self[name]

    def names(self):
        return list(_DDL)


TABLES = _Tables()


def conform(df, schema):
    """Columns of the schema in order, cast; absent ones NULL."""
    from pyspark.sql import functions as F
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])
