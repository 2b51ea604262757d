"""Reading result sets and writing evidence."""
