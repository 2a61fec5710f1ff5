"""Row shapes and the small ordered dimensions of the lead model.

The dimensions are fixed values; their order is match priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

TEXT_FIELDS = [
    "website", "phone", "phone_alt", "email", "address", "city", "state", "industry", "turnover", "employee_count", "gst",
    "cin", "region", "remarks", "followup", "contact_person", "designation", "linkedin_url",
]

COMPANY = StructType(
    [StructField("seq", LongType()), StructField("company_name", StringType(), False)]
    + [StructField(name, StringType()) for name in TEXT_FIELDS]
    + [StructField("validation_status", StringType()), StructField("validation_notes", ArrayType(StringType()))]
)
CONTACT = StructType([StructField(n, StringType()) for n in ("name", "designation", "email", "phone", "linkedin_url")])
LEAD = StructType([StructField("company", COMPANY), StructField("contacts", ArrayType(CONTACT)), StructField("keywords", ArrayType(StringType())), StructField("lead_score", DoubleType()), StructField("confidence_score", DoubleType())])
UNDERSTANDING = StructType([StructField(n, StringType()) for n in ("intent", "industry", "location", "buyer_persona", "workflow")] + [StructField("confidence", DoubleType())])
JOB_EVENT = StructType([StructField("id", LongType()), StructField("job_id", StringType()), StructField("created_at", StringType()), StructField("step", StringType()), StructField("status", StringType()), StructField("message", StringType())])
SEARCH_REQUEST = StructType([StructField("industry", StringType()), StructField("location", StringType()), StructField("keywords", ArrayType(StringType())), StructField("max_results", IntegerType())])

#: Fixed values: (level, industry).
INDUSTRIES = [
    (1, "Manufacturing"),
    (2, "Auto components"),
    (2, "Pump"),
    (2, "Valve"),
    (2, "Industrial equipments"),
    (2, "Sheet metal fabrication"),
    (2, "CNC job shop"),
    (2, "Electrical panel"),
    (3, "Foundry (Casting, Alloys, die, Tool die and moulds)"),
    (3, "Gears and gear boxes (bearing)"),
    (3, "Engineering (textile engineering components, agriculture engineering components)"),
    (3, "Precision (CNC)"),
    (3, "Defence and Aerospace Components"),
    (3, "Automotive"),
    (3, "Metal fabrication (sheet, steel, steel wires, steel coil, Press components)"),
    (3, "Plastic (Pipe, Tubes and Fittings, Plastic components manufacturing)"),
    (3, "Rubber (rubber components manufacturing)"),
    (3, "Electronic and electrical components"),
    (3, "Paper, printing and packaging"),
]
BROAD_INDUSTRY = "Manufacturing"

#: Fixed values: (function, its titles).
DESIGNATIONS = [
    ("IT", ["CIO", "CTO", "IT Head", "ERP Manager", "EDP Manager", "Technical Heads", "System Admin", "CISO", "Digital Transformation Head", "IS (Infrastructure)"]),
    ("HR", ["CHRO", "HR Head", "HR Manager", "Payroll Manager", "Talent Acquisition"]),
    ("C-Level", ["MD", "Managing Director", "CEO", "Director", "COO"]),
    ("Production", ["Factory Head", "Plant Head", "Production Manager", "Operations Head", "Shop Floor Manager"]),
    ("Finance", ["CFO", "Finance Manager", "Accounts Head", "Cost Accountant", "Commercial Head"]),
    ("Maintenance", ["Maintenance Manager", "Plant Head", "Engineering Head", "TPM Manager", "Utility Manager"]),
    ("Purchase", ["Purchase Manager", "Procurement Head", "Sourcing Manager", "Vendor Development", "Supply Chain"]),
    ("Sales", ["Business Head", "Sales Head", "Marketing Head"]),
    ("Service", ["Customer Support Manager"]),
    ("Quality", ["QA Manager", "QC Head", "Quality Engineer"]),
    ("Planning", ["PPC", "Production Planner", "Demand Planner"]),
    ("Warehouse", ["Stores Manager", "Warehouse Manager", "Inventory Controller"]),
    ("Logistics/Dispatch", []),
    ("R&D/Design/Engineering", []),
]
#: Fixed values: (band, least crore, below this many crore or no end).
TURNOVER_BANDS = [("Enterprise", 100.0, 500.0), ("Mid Market", 25.0, 100.0), ("MSME", 10.0, None)]
MIN_TURNOVER_CR = 10
MIN_EMPLOYEES = 100
#: Fixed values: (alias, city).
CITY_ALIASES = [
    ("coimbatore", "Coimbatore"), ("kovai", "Coimbatore"), ("bengaluru", "Bengaluru"), ("bangalore", "Bengaluru"),
    ("chennai", "Chennai"), ("madras", "Chennai"), ("tiruppur", "Tiruppur"), ("madurai", "Madurai"), ("salem", "Salem"),
    ("erode", "Erode"), ("hosur", "Hosur"), ("tiruchirappalli", "Tiruchirappalli"), ("trichy", "Tiruchirappalli"),
]
#: Fixed values.
STATES = [
    "Tamil Nadu", "Karnataka", "Kerala", "Andhra Pradesh", "Telangana", "Maharashtra", "Gujarat", "Rajasthan", "Delhi",
    "Uttar Pradesh", "West Bengal", "Madhya Pradesh", "Bihar", "Odisha", "Punjab", "Haryana", "Goa", "Puducherry",
]
#: Fixed values: (header, field) of the export.
EXPORT_COLUMNS = [
    ("Company Name", "company_name"), ("GST", "gst"), ("Turn Over", "turnover"), ("Region", "region"), ("City", "city"),
    ("Industry Type", "industry"), ("Contact Person", "contact_person"), ("Designation", "designation"),
    ("Mobile Number", "phone"), ("Alternate Mobile Number", "phone_alt"), ("Email ID", "email"), ("LinkedIN Id", "linkedin_url"),
    ("Website URL", "website"), ("Remarks", "remarks"), ("Followup", "followup"),
]
LEGACY_EXPORT_HEADERS = ("GST Confidence", "GST Sources")


def industries(spark: SparkSession) -> DataFrame:
    """(ord, level, name, term): term is what a text must contain."""
    return spark.createDataFrame([(i, level, name, name.split("(")[0].strip().lower()) for i, (level, name) in enumerate(INDUSTRIES)], "ord int, level int, name string, term string")


def titles(spark: SparkSession) -> DataFrame:
    """(ord, function, title) in taxonomy order."""
    rows = [(f, t) for f, own in DESIGNATIONS for t in own]
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(rows)], "ord int, function string, title string")


def with_company_fields(df: DataFrame) -> DataFrame:
    """``df`` with every company field, null where it has none."""
    from pyspark.sql import functions as F

    return df.select([F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in COMPANY])
