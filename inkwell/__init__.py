"""inkwell: corpus-scale analytics of CommonMark and GFM documents as ordinary Spark DataFrames."""
