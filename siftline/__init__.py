"""siftline: screening of document bundles and corpora as Spark DataFrame plans."""
