"""Entity types, their thresholds and the labels of token classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the types that differ from the standard one.
STANDARD = 0.75
THRESHOLDS = {
    "API_KEY": 0.5,
    "PASSWORD": 0.5,
    "CREDIT_CARD": 0.6,
    "IBAN": 0.6,
    "ACCOUNT_NUMBER": 0.6,
    "NATIONAL_ID": 0.6,
    "TAX_NUMBER": 0.6,
    "DRIVER_LICENSE": 0.6,
}
#: The entity types.
TYPES = (
    "GIVEN_NAME", "SURNAME", "PERSON_NAME", "EMAIL", "PHONE_NUMBER", "CREDIT_CARD", "STREET", "CITY", "ZIP_CODE", "DATE_OF_BIRTH", "ACCOUNT_NUMBER", "NATIONAL_ID",
    "TAX_NUMBER", "DRIVER_LICENSE", "USERNAME", "PASSWORD", "IP_ADDRESS", "API_KEY", "IBAN", "INTERNAL_URL", "SERVER_NAME", "FILE_PATH", "POSTAL_ADDRESS", "UNKNOWN",
)
#: Classifier labels, without their B- or I-, of each type.
LABELS = {
    "GIVEN_NAME": ("GIVENNAME", "FIRSTNAME"),
    "SURNAME": ("SURNAME", "LASTNAME"),
    "EMAIL": ("EMAIL",),
    "PHONE_NUMBER": ("TELEPHONENUM", "PHONE", "PHONE_NUMBER"),
    "CREDIT_CARD": ("CREDITCARDNUMBER", "CREDIT_CARD"),
    "STREET": ("STREET",),
    "CITY": ("CITY",),
    "ZIP_CODE": ("ZIPCODE", "ZIP_CODE"),
    "DATE_OF_BIRTH": ("DATEOFBIRTH", "DATE_OF_BIRTH"),
    "ACCOUNT_NUMBER": ("ACCOUNTNUM", "ACCOUNT_NUMBER", "IBAN"),
    "NATIONAL_ID": ("SOCIALNUM", "NATIONAL_ID", "SSN", "IDCARDNUM", "ID_CARD"),
    "TAX_NUMBER": ("TAXNUM", "TAX_NUMBER"),
    "DRIVER_LICENSE": ("DRIVERLICENSENUM", "DRIVER_LICENSE"),
    "USERNAME": ("USERNAME",),
    "PASSWORD": ("PASSWORD",),
    "IP_ADDRESS": ("IP_ADDRESS", "IP"),
}


def threshold(entity_type: Column) -> Column:
    out = F.lit(STANDARD)
    for t, x in THRESHOLDS.items():
        out = F.when(entity_type == t, F.lit(x)).otherwise(out)
    return out


def type_of_label(label: Column) -> Column:
    """The entity type of a label with or without B- or I-; null for O, UNKNOWN for what isn't known."""
    raw = F.regexp_replace(label, "^[BI]-", "")
    out = F.when(raw == "O", F.lit(None).cast("string"))
    for t, names in LABELS.items():
        out = out.when(raw.isin(*names), t)
    return out.otherwise("UNKNOWN")
