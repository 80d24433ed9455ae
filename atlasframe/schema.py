"""Column layouts of the dumps and of the tables made from them."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType()}


def layout(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns.items()])


# Field names and order of the public gazetteer dumps.
GEONAME = layout(
    geonameid="bigint", name="string", asciiname="string", alternatenames="string", latitude="double",
    longitude="double", fclass="string", fcode="string", country="string", cc2="string",
    admin1="string", admin2="string", admin3="string", admin4="string", population="bigint",
    elevation="bigint", gtopo30="bigint", timezone="string", moddate="string",
)
ADMIN1 = layout(key="string", name="string", asciiname="string", geonameid="bigint")
COUNTRY = layout(
    ISO="string", ISO3="string", IsoNumeric="string", fips="string", Country="string",
    Capital="string", Area="double", Population="bigint", Continent="string", tld="string",
    CurrencyCode="string", CurrencyName="string", Phone="string", PostalCodeFormat="string", PostalCodeRegex="string",
    Languages="string", geonameid="bigint", neighbours="string", EquivalentFipsCode="string",
)
DUMPS = {"geoname": GEONAME, "admin1": ADMIN1, "country": COUNTRY}

COUNTRIES = layout(country_id="int", country_name="string")
REGIONS = layout(region_id="int", region_name="string")
CITIES = layout(geohash="string", city_name="string", region_id="int", country_id="int")
VOCABULARY = layout(token_id="int", token="string")
