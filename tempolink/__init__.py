"""Event networks on Spark: eventise gridded series, compare every pair of places, keep the significant links."""
