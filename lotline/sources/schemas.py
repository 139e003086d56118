"""Declared schemas of the stored tables and of the normalised listing item."""

from pyspark.sql import types as T

# vehicles: one row per VIN (unique), 19 columns.
VEHICLES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("dealer", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("make", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("trim", T.StringType()),
    T.StructField("vin", T.StringType()),
    T.StructField("msrp", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("odometer", T.IntegerType()),
    T.StructField("ext_color", T.StringType()),
    T.StructField("int_color", T.StringType()),
    T.StructField("options", T.StringType()),
    T.StructField("dealer_platform", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("scraped_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

# Columns a vehicle row may not leave empty (NOT NULL in the stored table).
VEHICLES_REQUIRED = ["dealer", "title", "make", "model", "vin", "dealer_platform", "source_url"]

# The 16 columns of the listing API projection (drops options, updated_at, created_at).
API_COLUMNS = ["id", "dealer", "title", "year", "make", "model", "trim", "vin", "msrp", "price",
               "odometer", "ext_color", "int_color", "dealer_platform", "source_url", "scraped_at"]

# scrape_runs: run log.
RUNS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("platform", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("vehicles_scraped", T.IntegerType()),
    T.StructField("dealers_scraped", T.IntegerType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("completed_at", T.TimestampNTZType()),
    T.StructField("pid", T.IntegerType()),
])

# Normalised listing item produced by every platform normaliser (14 fields).
ITEM = T.StructType([
    T.StructField("vin", T.StringType()),
    T.StructField("dealer", T.StringType()),
    T.StructField("dealer_platform", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("trim", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("msrp", T.DoubleType()),
    T.StructField("ext_color", T.StringType()),
    T.StructField("int_color", T.StringType()),
    T.StructField("odometer", T.IntegerType()),
    T.StructField("options", T.StringType()),
])
ITEM_COLUMNS = [f.name for f in ITEM.fields]

# Dealer registry CSV: header Dealer, City, Website, Phone.
DEALERS_CSV = T.StructType([
    T.StructField("Dealer", T.StringType()),
    T.StructField("City", T.StringType()),
    T.StructField("Website", T.StringType()),
    T.StructField("Phone", T.StringType()),
])

# Capture table: one captured page payload per row.
CAPTURES = T.StructType([
    T.StructField("dealer", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("page_no", T.LongType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("next_url", T.StringType()),
    T.StructField("captured_at", T.TimestampNTZType()),
    T.StructField("payload", T.StringType()),
])
