"""The flat table of objects, storage classes and price tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: One row per object. Keys are unique and not empty; order is byte order.
OBJECTS = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("size", T.LongType(), False), T.StructField("class", T.IntegerType(), False)])
#: A line of a JSON listing.
LISTING = T.StructType([T.StructField("key", T.StringType()), T.StructField("size", T.LongType()), T.StructField("class", T.StringType())])
#: One row per prefix and storage class, of all objects below the prefix.
ROLLUP = T.StructType([T.StructField("prefix", T.StringType(), False), T.StructField("parent", T.StringType()), T.StructField("depth", T.IntegerType(), False), T.StructField("class", T.IntegerType(), False), T.StructField("objects", T.LongType(), False), T.StructField("bytes", T.LongType(), False)])

DELIMITER = "/"
#: Keys of one listing page at most.
PAGE = 1000

#: Storage classes, each at the place of its code.
CLASSES = ("UNKNOWN", "STANDARD", "STANDARD_IA", "ONEZONE_IA", "INTELLIGENT_TIERING", "GLACIER_IR", "GLACIER", "DEEP_ARCHIVE", "REDUCED_REDUNDANCY", "EXPRESS_ONEZONE", "SNOW")

#: Dollars for 1000 LIST requests, by region.
LIST_PRICES = {
    "us-east-1": 0.005, "us-east-2": 0.005, "us-west-1": 0.0055, "us-west-2": 0.005,
    "ca-central-1": 0.0055, "ca-west-1": 0.0055,
    "eu-west-1": 0.005, "eu-west-2": 0.0053, "eu-west-3": 0.0053, "eu-central-1": 0.0054, "eu-central-2": 0.0054, "eu-central-1-ist-1": 0.0054, "eu-north-1": 0.005, "eu-south-1": 0.0053, "eu-south-2": 0.0053,
    "ap-northeast-1": 0.0047, "ap-northeast-2": 0.0045, "ap-northeast-3": 0.0047, "ap-southeast-1": 0.005, "ap-southeast-2": 0.0055, "ap-southeast-3": 0.005, "ap-southeast-4": 0.0055, "ap-southeast-5": 0.0045, "ap-southeast-6": 0.005775, "ap-southeast-7": 0.0045,
    "ap-south-1": 0.005, "ap-south-2": 0.005, "ap-east-1": 0.005, "ap-east-2": 0.00423,
    "me-south-1": 0.0055, "me-central-1": 0.0055, "il-central-1": 0.0055, "af-south-1": 0.006, "sa-east-1": 0.007, "mx-central-1": 0.00525, "us-gov-east-1": 0.005, "us-gov-west-1": 0.005,
}
LIST_DEFAULT = 0.005

#: Dollars for a GiB and month, by region and class.
STORAGE_PRICES = {
    "us-east-1": {"STANDARD": 0.023, "STANDARD_IA": 0.0125, "ONEZONE_IA": 0.01, "INTELLIGENT_TIERING": 0.023, "GLACIER_IR": 0.004, "GLACIER": 0.0036, "DEEP_ARCHIVE": 0.00099, "REDUCED_REDUNDANCY": 0.024},
    "us-east-2": {"STANDARD": 0.023, "STANDARD_IA": 0.0125, "ONEZONE_IA": 0.01, "GLACIER_IR": 0.004, "GLACIER": 0.0036, "DEEP_ARCHIVE": 0.00099},
    "us-west-1": {"STANDARD": 0.026, "STANDARD_IA": 0.0138, "ONEZONE_IA": 0.011, "GLACIER_IR": 0.0044, "GLACIER": 0.004, "DEEP_ARCHIVE": 0.003},
    "us-west-2": {"STANDARD": 0.023, "STANDARD_IA": 0.0125, "ONEZONE_IA": 0.01, "GLACIER_IR": 0.004, "GLACIER": 0.0036, "DEEP_ARCHIVE": 0.00099},
    "eu-west-1": {"STANDARD": 0.023, "STANDARD_IA": 0.0125, "ONEZONE_IA": 0.01, "GLACIER_IR": 0.004, "GLACIER": 0.0036, "DEEP_ARCHIVE": 0.00099},
    "eu-central-1": {"STANDARD": 0.0245, "STANDARD_IA": 0.0131, "ONEZONE_IA": 0.0105, "GLACIER_IR": 0.0042, "GLACIER": 0.0038, "DEEP_ARCHIVE": 0.001},
    "ap-southeast-1": {"STANDARD": 0.025, "STANDARD_IA": 0.0138, "ONEZONE_IA": 0.011, "GLACIER_IR": 0.0043, "GLACIER": 0.0039, "DEEP_ARCHIVE": 0.001},
    "ap-northeast-1": {"STANDARD": 0.025, "STANDARD_IA": 0.0138, "ONEZONE_IA": 0.011, "GLACIER_IR": 0.0043, "GLACIER": 0.0039, "DEEP_ARCHIVE": 0.001},
    "sa-east-1": {"STANDARD": 0.0405, "STANDARD_IA": 0.0228, "ONEZONE_IA": 0.0182, "GLACIER_IR": 0.007, "GLACIER": 0.0064, "DEEP_ARCHIVE": 0.00228},
}
BASE_REGION = "us-east-1"
