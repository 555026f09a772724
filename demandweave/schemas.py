"""Column contracts of the warehouse and canonical names of the demand side."""

# --- fixed values: contract columns, keys and codes that results must match ---
DIM_DATE = [
    "date_key", "full_date", "day", "day_name", "day_of_week", "week", "month", "month_name",
    "month_year", "quarter", "year", "is_weekend", "is_month_start", "is_month_end",
    "is_quarter_end", "is_year_end", "financial_year", "financial_month",
]
DIM_PRODUCT = ["MDCODE", "MDNAME", "PACKG", "DETAIL", "SUPNO", "SUPCODE", "TCODE", "HSN", "UQC",
               "NEWDT", "SMDT", "SOURCE_MONTH"]
DIM_SUPPLIER = ["SUPNO", "SUPNAME", "SUPCODE", "OLDCODE", "RNAME", "RADD1", "RADD2", "RADD3",
                "RADD4", "RPHON", "SOURCE_MONTH"]
DIM_SALESPERSON = ["SCODE", "SNAME", "SOURCE_MONTH"]
DIM_TAX = ["TCODE", "STATUS", "CST", "TS", "ST", "SC", "RST", "TAXLESS", "CSTFLAG", "VATFLAG",
           "COMCODE", "IGST", "CGST", "SGST", "SOURCE_MONTH"]
FACT_SALES_INVOICE = ["INVNO", "INVDT", "TIME", "DUEDT", "SOURCE_MONTH", "CCODE", "ACODE", "SCODE",
                      "TOT_AMT", "DISC_PER", "FDISC_AMT", "ST_AMT", "NET_AMT", "CANCEL_ID", "REMARK"]
FACT_SALES_LINE = ["INVNO", "MDCODE", "BATCH", "EXP", "QTY", "FQTY", "RATE", "SERATE", "ACRATE",
                   "PRATE", "MRP", "TCODE", "CANCEL_ID", "SUPNO", "LPDT", "RATCHG", "SOURCE_MONTH"]
FACT_PURCHASE_HEADER = ["PINVNO", "PINVDT", "TRADT", "PACODE", "SUPNO", "CALVAL", "INVAMT",
                        "ADDDTL", "ADDAMT", "SOURCE_MONTH"]
FACT_PURCHASE_LINE = ["PINVNO", "MDCODE", "BAT", "EXP", "QTY", "FQTY", "PRATE", "SRATE", "MRP",
                      "TCODE", "SOH", "SOURCE_MONTH"]
FACT_INVOICE_DUE = ["INVNO", "CCODE", "SCODE", "INVDT", "DUEDT", "NET_AMT", "CANCEL_ID",
                    "SOURCE_MONTH"]

# Types of dimension columns that are not text.
DIMENSION_TYPES = {
    "NEWDT": "date", "SMDT": "date", "CST": "double", "TS": "double", "ST": "double", "SC": "double",
    "RST": "double", "IGST": "double", "CGST": "double", "SGST": "double",
}

LANDING_TABLES = ["INVOICE", "INVDET", "MEDIMAST", "PURCHASE", "COMPUR", "SUPMAST", "SFILE", "TFILE"]

# File name endings of the landing formats.
LANDING_EXTENSIONS = {"binary": "DAT", "parquet": "parquet", "csv": "csv"}

# Business keys audited for duplicates in each landed table.
DUPLICATE_KEYS = {
    "INVOICE": ["SOURCE_MONTH", "INVNO"],
    "INVDET": ["SOURCE_MONTH", "INVNO", "MDCODE", "BATCH"],
    "MEDIMAST": ["SOURCE_MONTH", "MDCODE"],
    "PURCHASE": ["SOURCE_MONTH", "PINVNO", "MDCODE", "BAT"],
    "COMPUR": ["SOURCE_MONTH", "PINVNO"],
    "SUPMAST": ["SOURCE_MONTH", "SUPNO"],
    "SFILE": ["SOURCE_MONTH", "SCODE"],
    "TFILE": ["SOURCE_MONTH", "TCODE"],
}

# (child table, parent table, key present on both sides)
REFERENCE_CHECKS = [
    ("INVDET", "INVOICE", "INVNO"),
    ("INVDET", "MEDIMAST", "MDCODE"),
    ("PURCHASE", "MEDIMAST", "MDCODE"),
    ("PURCHASE", "COMPUR", "PINVNO"),
    ("COMPUR", "SUPMAST", "SUPNO"),
    ("INVOICE", "SFILE", "SCODE"),
    ("INVDET", "TFILE", "TCODE"),
]

# Forecast contract.
HORIZON = 30
CONTEXT_LENGTH = 730
MIN_OBSERVATIONS = 3
QUANTILE_LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
QUANTILE_COLUMNS = ["P10", "P20", "P30", "P40", "P50", "P60", "P70", "P80", "P90"]
ROUTING_THRESHOLD = 30.0
PUBLISH_MIN_SUCCESS = 0.5
ADI_CUT = 1.32
CV2_CUT = 0.49

# Names under which one logical column may arrive; the first is canonical.
ALIASES = {
    "Medicine_ID": ["Medicine_ID", "item_id", "MDCODE"],
    "Forecast_Date": ["Forecast_Date", "timestamp", "INVDT"],
    "Demand_Qty": ["Demand_Qty", "target", "QTY"],
}
# --- end of fixed values ---


def canonicalise(df, names=tuple(ALIASES)):
    """Rename the first present alias of each logical column to its canonical name."""
    renames = {}
    for canonical in names:
        present = [a for a in ALIASES[canonical] if a in df.columns]
        if present and present[0] != canonical:
            renames[present[0]] = canonical
    return df.withColumnsRenamed(renames) if renames else df
