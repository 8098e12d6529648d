"""Set-oriented operators over tables of the scholarly graph."""
