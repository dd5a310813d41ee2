"""Training-data operators over the texts of safety data sheets; nothing outside this folder imports it."""
