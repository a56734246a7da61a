"""quillstone: document field extraction and analytics on PySpark."""
