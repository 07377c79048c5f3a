"""Documents from files, and models from their public JSON form or saved folders."""
