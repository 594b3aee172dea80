"""folioforge: captured legal pages to analytical tables on PySpark, with training-data operators beside it."""
