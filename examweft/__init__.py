"""examweft: exam-document analytics and training-data preparation as Spark plans."""
